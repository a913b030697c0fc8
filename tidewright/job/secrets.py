"""Secrets and remote files through an injected provider, or Hadoop's file systems."""

from __future__ import annotations

from typing import Any, ClassVar

from pyspark.sql import SparkSession

from tidewright.job.session import active_fallback


class SecretFetcher:
    """Reads secrets from the provider in ``dbutils``: a module whose ``DBUtils(spark)`` has ``secrets.get(scope, key)``."""

    dbutils: ClassVar[Any] = None

    @classmethod
    def fetch_secret(cls, scope: str, key: str) -> str:
        if cls.dbutils is None:
            raise RuntimeError("no provider of secrets was injected")
        return cls.dbutils.DBUtils(SparkSession.getActiveSession()).secrets.get(scope, key)


_FILES: dict[str, Any] = {}


def inject_dbutils(module: Any) -> None:  # noqa: ANN401
    """Set the provider of secrets and remote files."""
    SecretFetcher.dbutils = module
    _FILES["module"] = module


def _provider() -> Any:  # noqa: ANN401
    if "module" not in _FILES:
        raise RuntimeError("no provider of remote files was injected")
    return _FILES["module"].DBUtils(SparkSession.getActiveSession()).fs


def ls(path: str) -> list[Any]:
    return _provider().ls(path)


def mv(source: str, target: str, *, recurse: bool = False) -> Any:  # noqa: ANN401
    return _provider().mv(source, target, recurse)


def rm(path: str, *, recurse: bool = False) -> Any:  # noqa: ANN401
    return _provider().rm(path, recurse)


def mkdirs(path: str) -> Any:  # noqa: ANN401
    return _provider().mkdirs(path)


def copy_from_remote(source: str, target: str, *, recurse: bool = False) -> Any:  # noqa: ANN401
    return _provider().cp(source, target, recurse)


class HadoopFiles:
    """A provider over Hadoop's file systems, for ``inject_dbutils(HadoopFiles.module())``."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        from tidewright.sources.log import Files

        self.spark, self.kind = active_fallback(spark), Files

    def _at(self, path: str):  # noqa: ANN202
        return self.kind(self.spark, path)

    def ls(self, path: str) -> list[str]:
        return self._at(path).names(path)

    def mv(self, source: str, target: str, recurse: bool = False) -> bool:
        return self._at(source).rename(source, target)

    def rm(self, path: str, recurse: bool = False) -> bool:
        return self._at(path).delete(path)

    def mkdirs(self, path: str) -> bool:
        files = self._at(path)
        return files.fs.mkdirs(files.path(path))

    def cp(self, source: str, target: str, recurse: bool = False) -> bool:
        a, b = self._at(source), self._at(target)
        return a.jvm.org.apache.hadoop.fs.FileUtil.copy(a.fs, a.path(source), b.fs, b.path(target), False, a.conf)
