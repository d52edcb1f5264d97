"""From a snapshot relation to typed directories, files and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import COLUMNS, RECORDS, U64, U64_MAX, WIDE, SnapshotError
from .order import carry_forward

DIAGNOSTICS = ("excluded_dirs", "excluded_files", "excluded_bytes", "missing_total", "malformed", "errors")


@dataclass
class Snapshot:
    """dirs: dir, ord, blocks, links.  files: dir, name, size, stamp, attrs.  checks and problems are lazy frames."""

    dirs: DataFrame
    files: DataFrame
    checks: DataFrame
    problems: DataFrame
    excluded: DataFrame

    def validate(self) -> None:
        """Raises on what makes a snapshot unreadable; one aggregate over all rows."""
        found = self.checks.first()
        for name, message in CHECKS.items():
            if found[name]:
                raise SnapshotError(message)
        if not found["headers"]:
            raise SnapshotError("No directory headers in input. Expected ls -lR output.")

    def diagnostics(self) -> dict:
        """The counters and up to three examples of malformed rows, in source order."""
        p = self.problems.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("malformed", "errors")]).first()
        e = self.excluded.first()
        examples = [r["example"] for r in self.problems.where("malformed = 1").orderBy("row_index").limit(3).select("example").collect()]
        return {**e.asDict(), **p.asDict(), "examples": examples}


CHECKS = {
    "null_cells": "NULL in a snapshot cell",
    "unknown": "Unexpected snapshot record",
    "mismatched": "Snapshot row does not match its directory header",
    "orphans": "Entry before directory header",
    "outside": "Directory outside the root of the listing",
}


def read(rows: DataFrame, block_size: int = 1024, include_merged: bool = False) -> Snapshot:
    """The snapshot of a relation (row_index and the twelve columns)."""
    rows = carry_forward(rows, F.when(F.col("record") == "directory", F.struct("directory", "row_index")), "_head")
    cells = F.greatest(*[F.col(f"`{c}`").isNull() for c in COLUMNS])
    heads = rows.where("record = 'directory'")
    root = heads.agg(F.min_by("directory", "row_index").alias("_root"))  # one row: a join with it moves nothing
    rows = rows.join(F.broadcast(root), F.lit(True), "left")
    inside = F.col("_head").isNotNull()
    rows = rows.withColumns({"dir": X.relative(F.col("_head.directory"), F.col("_root")), "skip": inside & ~F.lit(include_merged) & X.is_merged(F.col("_head.directory"))})
    permissions = F.col("permissions")
    good, kind = X.permissions_record(permissions), F.substring("permissions", 1, 1)
    entry = F.col("record") == "entry"
    size = X.u64(F.col("size_or_device"))
    is_file = entry & good & (kind == "-")
    bad_entry = entry & (~good | (is_file & size.isNull()))
    is_total = F.col("record").isin("total", "total_bytes")
    blocks = X.scaled(X.u64(F.col("total")), F.when(F.col("record") == "total_bytes", 1).otherwise(block_size))
    bad_total = is_total & blocks.isNull()
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    checks = rows.agg(
        flag(cells).alias("null_cells"),
        flag(~F.col("record").isin(*RECORDS)).alias("unknown"),
        flag(inside & (F.col("directory") != F.col("_head.directory"))).alias("mismatched"),
        flag(entry & ~inside).alias("orphans"),
        flag(inside & F.col("dir").isNull()).alias("outside"),
        flag(F.col("record") == "directory").alias("headers"),
    )
    spaced = F.concat_ws(" ", *[F.col(f"`{c}`") for c in COLUMNS[2:11]])
    example = F.when(F.col("record") == "unparsed", F.col("name")).when(bad_entry, spaced).otherwise(F.concat(F.lit("total "), "total"))
    bad = (F.col("record") == "unparsed") | bad_entry | bad_total
    error = F.col("record") == "ls_error"
    problems = rows.where(bad | error).select("row_index", F.when(bad, 1).otherwise(0).alias("malformed"), F.when(error, 1).otherwise(0).alias("errors"), example.alias("example"))
    # a directory is one header: what follows it, up to the next
    per_head = rows.where(inside).groupBy(F.col("_head.row_index").alias("ord"), "dir", "skip").agg(
        F.max_by(F.when(is_total, blocks), F.when(is_total & blocks.isNotNull(), F.col("row_index"))).alias("blocks"),
        F.sum(F.when(entry & good & (kind == "l"), 1).otherwise(0)).alias("links"),
        F.sum(F.when(is_file & size.isNotNull(), 1).otherwise(0)).alias("n_files"),
        F.sum(F.when(is_file, size).otherwise(F.lit(0).cast(U64))).alias("bytes"),
    )
    excluded = per_head.agg(
        flag(F.col("skip")).alias("excluded_dirs"),
        F.coalesce(F.sum(F.when(F.col("skip"), F.col("n_files"))), F.lit(0)).alias("excluded_files"),
        F.coalesce(F.sum(F.when(F.col("skip"), F.col("bytes"))), F.lit(0)).alias("excluded_bytes"),
        flag(~F.col("skip") & F.col("blocks").isNull()).alias("missing_total"),
    )
    dirs = per_head.where(~F.col("skip")).select("dir", "ord", F.coalesce("blocks", F.lit(0)).cast(U64).alias("blocks"), F.col("links").cast("long").alias("links"))
    stamp = F.struct("month", "day", "time_or_year")
    attrs = F.struct("permissions", "links", "owner", F.col("`group`"))
    files = rows.where(is_file & size.isNotNull() & inside & ~F.col("skip")).select("dir", "name", size.alias("size"), stamp.alias("stamp"), attrs.alias("attrs"))
    return Snapshot(dirs, files, checks, problems, excluded)


def checked(total: Column, name: str) -> Column:
    """total as an unsigned 64-bit integer; beyond it the query fails."""
    ok = F.coalesce(total <= F.lit(str(U64_MAX)).cast(WIDE), F.lit(True))
    return F.when(ok, total.cast(U64)).otherwise(F.raise_error(F.lit(f"{name} overflow")).cast(U64))
