"""Sinks: one file each, written beside its place and linked there, never over another file."""

from __future__ import annotations

import contextlib
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_cell
from ..schema import COLUMNS, TEXT_LINE, SnapshotError
from .text import HEADER


@contextlib.contextmanager
def staged(output: str) -> Iterator[str]:
    """A path in a folder of its own beside output; what stands there in the end becomes output."""
    if os.path.lexists(output):
        raise SnapshotError(f"Output already exists: {output}")
    folder = tempfile.mkdtemp(prefix=".treeledger-", dir=os.path.dirname(os.path.abspath(output)))
    try:
        path = os.path.join(folder, "out")
        yield path
        os.link(path, output)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def tsv_lines(rows: DataFrame) -> DataFrame:
    """row_index and line, in no order."""
    line = F.concat_ws("\t", *[encode_cell(F.col(f"`{c}`")) for c in COLUMNS])
    long = F.octet_length(line) > TEXT_LINE
    return rows.select("row_index", F.when(long, F.raise_error(F.lit("Snapshot row exceeds its limit")).cast("string")).otherwise(line).alias("line"))


def write_tsv_stream(rows: DataFrame, out: BinaryIO) -> int:
    """Header and rows in source order, partition by partition; returns the number of rows."""
    out.write(f"{HEADER}\n".encode())
    n = 0
    for r in tsv_lines(rows).orderBy("row_index").select("line").toLocalIterator(prefetchPartitions=True):
        out.write(f"{r['line']}\n".encode())
        n += 1
    return n


def write_tsv(rows: DataFrame, output: str) -> None:
    with staged(output) as path, open(path, "wb") as f:
        write_tsv_stream(rows, f)


def renumbered(rows: DataFrame) -> DataFrame:
    """row_index from 1 without gaps, in source order."""
    from .text import number_rows

    return number_rows(rows.withColumnRenamed("row_index", "_old"), "_old").select("row_index", *[f"`{c}`" for c in COLUMNS])


def write_parquet(rows: DataFrame, output: str) -> None:
    """One file in row order.  A range sort does the work; the last task only joins sorted partitions."""
    with staged(output) as path:
        renumbered(rows).coalesce(1).sortWithinPartitions("row_index").write.parquet(f"{path}.d")
        parts = [x for x in os.listdir(f"{path}.d") if x.endswith(".parquet")]
        os.rename(f"{path}.d/{parts[0]}", path)


def write_sqlite(rows: DataFrame, output: str) -> None:
    with staged(output) as path:
        with contextlib.closing(sqlite3.connect(path)) as db, db:
            db.execute(f"CREATE TABLE snapshot(row_index INTEGER PRIMARY KEY, {', '.join(f'"{c}" TEXT NOT NULL' for c in COLUMNS)})")
            found = (tuple(r) for r in renumbered(rows).orderBy("row_index").toLocalIterator(prefetchPartitions=True))
            db.executemany(f"INSERT INTO snapshot VALUES ({', '.join('?' * 13)})", found)


WRITERS = {"tsv": write_tsv, "parquet": write_parquet, "sqlite": write_sqlite}
