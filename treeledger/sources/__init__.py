"""Readers by format name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import SnapshotError
from . import artifacts, text

FORMATS = ("ls", "find", "tsv", "sqlite", "duckdb", "parquet")


def load(spark: SparkSession, path: str, kind: str, report: bool = True) -> DataFrame:
    """The snapshot relation of a file, or of standard input (-) for the text formats."""
    if kind not in FORMATS:
        raise SnapshotError(f"no reader for {kind}; there are {' '.join(FORMATS)}")
    if kind in ("ls", "find", "tsv"):
        path = text.spool(spark, path)
        return text.read_listing(spark, path, report) if kind == "ls" else text.read_find(spark, path) if kind == "find" else text.read_tsv(spark, path)
    return artifacts.read_parquet(spark, path) if kind == "parquet" else artifacts.read_database(spark, path, kind)
