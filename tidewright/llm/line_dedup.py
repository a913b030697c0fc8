"""Boilerplate lines by distinct-site spread.

A line that many sites share is boilerplate. Copies of a document must not make its own lines so. There are two ways
(``copies``): by "text", as the query's SQL has it, all rows of one whole text count for one site, the smallest. By
"near", a line counts for every site that has it in a document which follows no near-duplicate. Lines inside menus,
notices and footers count in full either way.

Lines are 128-bit hashes. Those seen at one site only go first, by a plain aggregate. HyperLogLog sketches of the sites
of the others merge by aggregation, from the map side on; lines whose estimate is near the threshold get exact distinct
counts. The result is that of exact counting, but exact sets are kept for few lines.

Defined results: null texts stay null and have no lines; empty and blank lines are never boilerplate; null sites count
as none; repeated rows count once; rows that repeat an id with another text are judged each by its own lines, rows without
an id too; a document may become empty, and stays as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import small_or_shuffled, written
from tidewright.llm.simhash import BROADCAST_IDS, near_duplicates

MIN_SITES = 10
#: Entries of a sketch: 2**12, which has a relative standard error of 1.6 % and is all but exact for small counts.
LOG_SIZE = 12
#: Estimates within this share of the threshold are counted exactly; over six standard errors.
BAND = 0.1
BROADCAST_LINES = 200_000


def _lines(df: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """``others`` and (at, h1, h2) of the lines that are not blank."""
    # the parts are a column of their own: within the lambda they'd be split again for every line
    rows = F.transform(
        "parts", lambda x, i: F.when(F.length(F.trim(x)) > 0, F.struct(i.alias("at"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    )
    split = df.select(*others, F.split(F.col(text_col), "\n").alias("parts"))
    keep = [c for c in split.columns if c != "parts"]
    return split.select(*keep, F.explode(rows).alias("r")).where("r IS NOT NULL").select(*keep, "r.*")


def _whole(text_col: str, *more: str) -> list[Column]:
    """128 bits of a whole text (and of other columns), as w1 and w2."""
    return [F.xxhash64(F.lit(k), *more, F.col(text_col)).alias(f"w{k}") for k in (1, 2)]


def boilerplate(
    df: DataFrame, *, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", copies: str = "text"
) -> DataFrame:
    """(h1, h2) of the lines that stand at ``min_sites`` sites or more."""
    if copies not in ("text", "near"):
        raise ValueError(f"copies: {copies}")
    sited = df.where(F.col(site_col).isNotNull())
    site = F.col(site_col).cast("string").alias("site")
    lines = _lines(sited, text_col, site, *(_whole(text_col) if copies == "text" else [])).drop("at")
    # numbers take part in Spark's hash aggregates, strings of different lengths don't
    bounds = lines.groupBy("h1", "h2").agg(F.min(F.xxhash64("site")).alias("lo"), F.max(F.xxhash64("site")).alias("hi"))
    shared = written(bounds.where("lo < hi").select("h1", "h2"), "shared-lines")
    among = lines.join(small_or_shuffled(shared, BROADCAST_LINES), ["h1", "h2"], "left_semi")
    if copies == "text":
        return _spread(written(among.groupBy("h1", "h2", "w1", "w2").agg(F.min("site").alias("site")).select("h1", "h2", "site"), "line-sites"), min_sites)
    wide = written(_spread(written(among.select("h1", "h2", "site").distinct(), "line-sites"), min_sites), "wide")
    # copies matter among the documents with such lines only
    named = _lines(sited, text_col, F.col(id_col).cast("long").alias("doc_id"), site).select("doc_id", "site", "h1", "h2")
    held = written(named.join(small_or_shuffled(wide, BROADCAST_LINES), ["h1", "h2"], "left_semi").distinct(), "held")
    holders = small_or_shuffled(written(held.select("doc_id").distinct(), "holders"), BROADCAST_IDS)
    texts = sited.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(holders, "doc_id", "left_semi")
    followers = small_or_shuffled(written(near_duplicates(texts).select("doc_id").distinct(), "followers"), BROADCAST_IDS)
    return _spread(written(held.join(followers, "doc_id", "left_anti").select("h1", "h2", "site").distinct(), "line-sites"), min_sites)


def _spread(sites: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) with at least ``min_sites`` different sites among (h1, h2, site)."""
    spread = sites.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SIZE))).alias("n"))
    spread = written(spread.where(F.col("n") >= min_sites * (1 - BAND) - 1), "spread")
    near = F.col("n") <= min_sites * (1 + BAND) + 1
    unsure = small_or_shuffled(spread.where(near).select("h1", "h2"), BROADCAST_LINES)
    counted = sites.join(unsure, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n"))
    return spread.where(~near).select("h1", "h2").union(counted.where(F.col("n") >= min_sites).select("h1", "h2"))


def drop_boilerplate(
    df: DataFrame, *, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", copies: str = "text"
) -> DataFrame:
    """All columns of ``df``, texts without their boilerplate lines, and n_lines and n_removed (under clashing names
    the new columns win)."""
    lines = written(boilerplate(df, min_sites=min_sites, id_col=id_col, site_col=site_col, text_col=text_col, copies=copies), "boilerplate")
    drop_col, parts_col, key = "_tidewright_drop", "_tidewright_parts", ["_tidewright_w1", "_tidewright_w2"]
    # a row is known by its id and text: rows that agree in both lose the same lines, and no key is hot
    ident = [c.alias(n) for c, n in zip(_whole(text_col, id_col), key, strict=True)]
    each = _lines(df, text_col, *ident)
    drop = each.join(small_or_shuffled(lines, BROADCAST_LINES), ["h1", "h2"], "left_semi").groupBy(*key).agg(F.collect_set("at").alias(drop_col))
    joined = df.select("*", *ident).join(drop, key, "left").withColumn(parts_col, F.split(F.col(text_col), "\n"))
    kept = F.array_join(F.filter(parts_col, lambda x, i: ~F.array_contains(drop_col, i)), "\n")
    new = {
        text_col: F.when(F.col(drop_col).isNull(), F.col(text_col)).otherwise(kept),
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts_col)).cast("long"),
        "n_removed": F.when(F.col(drop_col).isNull(), 0).otherwise(F.size(drop_col)).cast("long"),
    }
    return joined.withColumns(new).drop(drop_col, parts_col, *key)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT line, text, min(source) AS site FROM l WHERE length(trim(line, ' ')) > 0 AND source IS NOT NULL GROUP BY line, text
), b AS (SELECT line FROM s GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (
  SELECT doc_id, text, max(pos) AS n_lines, count(DISTINCT CASE WHEN b.line IS NOT NULL THEN pos END) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS kept
  FROM (SELECT DISTINCT doc_id, text, line, pos FROM l) l LEFT JOIN b ON l.line = b.line GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND d.text = k.text
"""
