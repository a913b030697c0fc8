"""Environments, job configuration and names of tables in catalogs."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import SparkSession

from tidewright.job.secrets import SecretFetcher

_log = logging.getLogger(__name__)


class Environment(Enum):
    DEV = "dev"
    STAGING = "staging"
    PROD = "prod"


def environment() -> Environment:
    """From the session's ``spark.env``, the variables ENV or ENVIRONMENT, or dev; unknown names are dev."""
    session = SparkSession.getActiveSession()
    widget = session.conf.get("spark.env", None) if session else None
    name = (widget or os.environ.get("ENV") or os.environ.get("ENVIRONMENT") or "dev").lower()
    try:
        return Environment(name)
    except ValueError:
        _log.warning("unknown environment %r; using dev", name)
        return Environment.DEV


@dataclass
class JobConfig:
    """Physical names of tables by logical ones, and what a job sets."""

    tables: Mapping[str, str] = field(default_factory=dict)
    secret_scope: str | None = None
    storage_root: str | None = None
    spark_configs: Mapping[str, str] = field(default_factory=dict)
    env: Environment = field(default_factory=environment)

    def table(self, name: str) -> str:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {sorted(self.tables)}")
        return self.tables[name]

    def secret(self, key: str) -> str:
        if not self.secret_scope:
            raise ValueError("the configuration has no secret scope")
        return SecretFetcher.fetch_secret(self.secret_scope, key)

    @classmethod
    def from_env(cls, **fields: Any) -> JobConfig:  # noqa: ANN401
        """With the environment of now."""
        return cls(**fields, env=environment())


@dataclass
class UnityConfig(JobConfig):
    """Three-part names ``prefix_env.schema.table``."""

    catalog_prefix: str = ""
    schemas: list[str] = field(default_factory=list)

    @property
    def catalog(self) -> str:
        return f"{self.catalog_prefix}_{self.env.value}"

    def table(self, name: str) -> str:
        schema, dot, table = name.partition(".")
        if not dot or not schema or not table or "." in table:
            raise ValueError(f"{name!r} is not schema.table")
        if schema not in self.schemas:
            raise KeyError(f"no schema {schema!r}; there are {sorted(self.schemas)}")
        return f"{self.catalog}.{schema}.{table}"


class CatalogSchema:
    """Tables of a schema as attributes; versioned ones map an alias to a physical name."""

    def __init__(self, name: str, tables: list[str], versioned_tables: Mapping[str, str] | None = None) -> None:
        self._name = name
        self._known = {t: f"{name}.{t}" for t in tables} | {a: f"{name}.{t}" for a, t in (versioned_tables or {}).items()}

    def __getattr__(self, table: str) -> str:
        if table.startswith("_"):
            raise AttributeError(table)
        if table not in self._known:
            raise AttributeError(f"schema {self._name} has no table {table!r}; there are {sorted(self._known)}")
        return self._known[table]

    def __dir__(self) -> list[str]:
        return sorted(self._known)
