"""Saved snapshots: Parquet by Spark's own reader; SQLite and DuckDB files by Python data sources, in ranges of row_index."""

from __future__ import annotations

import contextlib
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import COLUMNS, SNAPSHOT, SnapshotError
from .text import _rows

RANGE_ROWS = 500_000
_SELECT = ", ".join(["row_index", *(f'"{c}"' for c in COLUMNS)])


def _connect(engine: str, path: str):
    """A read-only connection; the file must be where the reading task runs."""
    if engine == "sqlite":
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    import duckdb

    return duckdb.connect(path, read_only=True)


class Range(InputPartition):
    """A range of the column by, and how many rows it has."""

    def __init__(self, by: str, lo: int, hi: int, rows: int):
        super().__init__((by, lo, hi, rows))
        self.by, self.lo, self.hi, self.rows = by, lo, hi, rows


class SnapshotReader(DataSourceReader):
    """Ranges of the table's own row numbers, which need no index, or of row_index where a table or view has none.

    The rows of all ranges are counted first; a range that delivers another number fails.
    """

    def __init__(self, engine: str, path: str):
        self.engine, self.path = engine, path

    def partitions(self) -> list[Range]:
        with contextlib.closing(_connect(self.engine, self.path)) as db:
            for by in ("rowid", "row_index"):
                try:
                    n, lo, hi = db.execute(f"SELECT count(*), min({by}), max({by}) FROM snapshot").fetchone()
                    break
                except Exception:
                    if by == "row_index":
                        raise
            if not n or lo is None:
                return [Range("row_index", 0, -1, 0)] if not n else self._nulls(n)
            step = max(1, -(-(hi - lo + 1) * RANGE_ROWS // n))
            cut = f"({by} - ({lo})) / {step}" if self.engine == "sqlite" else f"({by} - ({lo})) // {step}"
            counts = db.execute(f"SELECT {cut}, count(*) FROM snapshot WHERE {by} IS NOT NULL GROUP BY 1 ORDER BY 1").fetchall()
        found = [Range(by, lo + int(k) * step, min(lo + int(k) * step + step - 1, hi), rows) for k, rows in counts]
        missing = n - sum(r.rows for r in found)
        return found + (self._nulls(missing) if missing else [])

    def _nulls(self, n: int) -> list[Range]:
        raise SnapshotError(f"NULL row_index in {n} rows")

    def read(self, partition: Range):
        delivered = 0
        with contextlib.closing(_connect(self.engine, self.path)) as db:
            found = db.execute(f"SELECT {_SELECT} FROM snapshot WHERE {partition.by} BETWEEN ? AND ?", (partition.lo, partition.hi))
            while rows := found.fetchmany(5000):
                delivered += len(rows)
                yield from (tuple(r) for r in rows)
        if delivered != partition.rows:
            raise SnapshotError(f"{self.path}: {delivered} rows came of {partition.rows}")


class SqliteSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_sqlite"

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        return SnapshotReader("sqlite", self.options["path"])


class DuckdbSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_duckdb"

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        return SnapshotReader("duckdb", self.options["path"])


def restored(rows: DataFrame) -> DataFrame:
    """Snapshot rows whose row_index gives the source order; it must be there and be unique."""
    bad = rows.agg(F.count(F.when(F.col("row_index").isNull(), 1)).alias("absent")).first()["absent"]
    if bad:
        raise SnapshotError("NULL row_index")
    if rows.groupBy("row_index").count().where("count > 1").limit(1).count():
        raise SnapshotError("Duplicate row_index")
    return _rows(rows)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return restored(spark.read.schema(SNAPSHOT).parquet(path))


def read_database(spark: SparkSession, path: str, engine: str) -> DataFrame:
    source = {"sqlite": SqliteSnapshot, "duckdb": DuckdbSnapshot}[engine]
    spark.dataSource.register(source)
    return restored(spark.read.format(source.name()).load(path))
