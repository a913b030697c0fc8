"""The corpus pipeline: documents -> toxicity -> line dedup -> near duplicates -> decontamination -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.

Defined results: null and empty texts pass every filter (an empty text scores as clean, has no lines and no words) and
are packed as a single end id each; they are nobody's near-duplicates. Rows that repeat an id stay rows of their own,
save that a near-duplicate's id goes with all its rows. Rows without an id pass. Without labels of both kinds no document
is toxic, without a benchmark nothing is cut, and an empty table gives no pieces. Other columns pass through, whatever
their names; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontamination, line_dedup, packing, simhash, toxicity
from tidewright.llm.common import discard, kept, table, temporary, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand at ten sites or more go from all texts; near copies don't count."""
    kept = line_dedup.drop_boilerplate(docs, copies="near")
    return kept.select(*((F.length("text") if c == "n_chars" else F.col(c)).cast(kind).alias(c) for c, kind in docs.dtypes))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five-word shingles stays."""
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten words or more of a benchmark item go; a document over half of which they cover goes whole."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences along the Hilbert curve."""
    return packing.pack(docs, tokenizer="byte_bpe_50k.json", keep_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. The state between them lies in the shared folder; what a stage leaves there is
    deleted when the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary(spark):
            docs = kept(written(stage(spark, before, sf_dir), f"stage-{name}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, sketches and similarity search aren't expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
