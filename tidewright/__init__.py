"""Lakehouse pipelines on plain Spark: filters, quality, merge kernels, versioned tables, streaming, observability.

The library's main names can be imported from here; their modules load when a name is first used.
"""

from importlib import import_module

__version__ = "0.2.0"
_HOMES = {
    "job.config": ("CatalogSchema", "Environment", "JobConfig", "UnityConfig"),
    "job.logs": ("configure_logging", "get_logger"),
    "job.metrics": ("CompositeMetricsSink", "LoggingMetricsSink", "MetricEvent", "MetricsSink", "TableMetricsSink"),
    "job.retry": ("RetryConfig", "retry"),
    "job.secrets": ("SecretFetcher", "inject_dbutils"),
    "job.session": ("active_fallback", "get_active", "get_or_create_local_session"),
    "job.workflow": ("Workflow",),
    "operators.filters": ("ColumnFilter", "DropDuplicates", "Filter", "FilterPipeline", "WhereFilter"),
    "operators.quality": ("QualityError", "QualityGate", "QualityReport"),
    "plans.lint": ("check_collect_safety", "lint"),
    "schema.alter": ("TableAlter",),
    "schema.diff": ("SchemaDiff",),
    "schema.migrations": ("MigrationRunner", "MigrationStep"),
    "schema.validators": ("TableValidator", "describe_table"),
    "sources.maintenance": ("MaintenanceRunner",),
    "sources.versioned": (
        "GeneratedColumn", "MergeBuilder", "TableAppender", "TableOverwriter", "VersionedTable", "append_without_duplicates", "drop_duplicates_pkey",
        "kill_duplicates", "optimize_table", "vacuum_table", "analyze_table",
    ),
    "streaming.checkpoint": ("CheckpointManager", "check_compatibility", "diagnose_checkpoint"),
    "streaming.observe": ("QueryProgressObserver", "StreamingHealthCheck"),
    "streaming.reader": ("StreamingTableReader", "StreamingTrigger"),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str) -> object:
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__} has no {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME_OF[name]}"), name)


def __dir__() -> list[str]:
    return [*__all__, "__version__"]
