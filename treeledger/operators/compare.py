"""Comparison of two snapshots: changes of files, and counters of directories, path groups and everything.

Both sides are tagged and met by file in one exchange; equal keys on one side show up as counts without another pass.
Directory counters are added up where the files are before they are exchanged, so a directory of any size is no burden
for one task.  Numbers of things are longs; only sums of bytes are wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import COUNTERS, U64, WIDE
from .snapshot import checked


def _sides(before: DataFrame | None, after: DataFrame, columns: list[str]) -> DataFrame:
    tag = lambda df, side: df.select(*columns, F.lit(side).alias("side"))
    return tag(after, 1) if before is None else tag(before, 0).unionByName(tag(after, 1))


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """One row per file of either side: dir, name, old, new, kind, n_before, n_after.

    kind: added, removed, resized, mtime_only, attrs_only or same; a changed size hides a changed stamp, and that hides
    changed attributes.  Without before every file is added.
    """
    both = _sides(before, after, ["dir", "name", "size", "stamp", "attrs"])
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    met = both.groupBy("dir", "name").agg(
        *[pick(c, side).alias(f"{c}{side}") for side in (0, 1) for c in ("size", "stamp", "attrs")],
        F.count(F.when(F.col("side") == 0, 1)).alias("n_before"),
        F.count(F.when(F.col("side") == 1, 1)).alias("n_after"),
    )
    kind = (
        F.when(F.col("n_before") == 0, "added")
        .when(F.col("n_after") == 0, "removed")
        .when(F.col("size0") != F.col("size1"), "resized")
        .when(F.col("stamp0") != F.col("stamp1"), "mtime_only")
        .when(F.col("attrs0") != F.col("attrs1"), "attrs_only")
        .otherwise("same")
    )
    return met.select("dir", "name", F.col("size0").alias("old"), F.col("size1").alias("new"), kind.alias("kind"), "n_before", "n_after")


def duplicates(changed: DataFrame) -> DataFrame:
    """The files that stand more than once on a side."""
    return changed.where("n_before > 1 or n_after > 1").select("dir", "name")


def added(changed: DataFrame) -> DataFrame:
    return changed.where("kind = 'added'").select("dir", "name")


def removed(changed: DataFrame) -> DataFrame:
    return changed.where("kind = 'removed'").select("dir", "name")


def common(changed: DataFrame) -> DataFrame:
    """The files of both sides."""
    return changed.where("n_before > 0 and n_after > 0").select("dir", "name")


def directory_summary(changed: DataFrame, dirs_before: DataFrame | None, dirs_after: DataFrame) -> DataFrame:
    """dir and the 19 counters, of direct files."""
    zero = F.lit(0).cast(U64)
    old, new, kind = F.coalesce("old", zero), F.coalesce("new", zero), F.col("kind")
    n = lambda cond: F.count(F.when(cond, 1))
    size = lambda cond, value: F.sum(F.when(cond, value))
    files = changed.groupBy("dir").agg(
        n(F.col("n_before") > 0).alias("old_files"), n(F.col("n_after") > 0).alias("new_files"), F.sum("old").alias("old_bytes"), F.sum("new").alias("new_bytes"),
        *[n(kind == k).alias(k) for k in ("added", "removed", "resized", "mtime_only", "attrs_only")],
        size(kind == "added", new).alias("added_bytes"), size(kind == "removed", old).alias("removed_bytes"),
        size((kind == "resized") & (new > old), new - old).alias("grown_bytes"), size((kind == "resized") & (old > new), old - new).alias("shrunk_bytes"),
    )
    kinds = {c: F.lit(0).cast(WIDE if c.endswith(("_bytes", "_blocks")) else "long") for c in COUNTERS}
    have = lambda frame, given: frame.select("dir", *[(F.coalesce(given[c].cast(v_type(c)), v) if c in given else v).alias(c) for c, v in kinds.items()])
    v_type = lambda c: WIDE if c.endswith(("_bytes", "_blocks")) else "long"
    rows = have(files, {c: F.col(c) for c in files.columns if c != "dir"})
    for side, dirs in (("old", dirs_before), ("new", dirs_after)):
        if dirs is not None:
            rows = rows.unionByName(have(dirs, {f"{side}_dirs": F.lit(1), f"{side}_links": F.col("links"), f"{side}_blocks": F.col("blocks")}))
    return rows.groupBy("dir").agg(*[checked(F.sum(c).cast(WIDE), c).alias(c) for c in COUNTERS])


def total(summary: DataFrame) -> DataFrame:
    return summary.agg(*[checked(F.coalesce(F.sum(c), F.lit(0)).cast(WIDE), c).alias(c) for c in COUNTERS])


def groups(summary: DataFrame, depth: int) -> DataFrame:
    """path and the counters of everything below the first depth components."""
    return summary.groupBy(X.bucket(F.col("dir"), depth).alias("path")).agg(*[checked(F.sum(c), c).alias(c) for c in COUNTERS])


def wide(c: str) -> Column:
    return F.col(c).cast(WIDE)


def delta() -> Column:
    return wide("new_bytes") - wide("old_bytes")


def block_delta() -> Column:
    return wide("new_blocks") - wide("old_blocks")


def file_delta() -> Column:
    return wide("new_files") - wide("old_files")


def is_changed() -> Column:
    return (F.col("added") + F.col("removed") + F.col("resized") + F.col("mtime_only") + F.col("attrs_only") > 0) | (block_delta() != 0) | (F.col("old_dirs") != F.col("new_dirs")) | (F.col("old_links") != F.col("new_links"))


def _top(rows: DataFrame, score: Column, n: int, *ties: str) -> DataFrame:
    return rows.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(n)


def top_groups(grouped: DataFrame, n: int, compare: bool) -> DataFrame:
    return _top(grouped, F.abs(delta()) if compare else wide("new_bytes"), n, "path")


def largest_dirs(summary: DataFrame, n: int) -> DataFrame:
    return _top(summary.where("new_files > 0"), wide("new_bytes"), n, "dir")


def count_dirs(summary: DataFrame, n: int) -> DataFrame:
    return _top(summary.where(file_delta() != 0), F.abs(file_delta()), n, "dir")


def growing_dirs(summary: DataFrame, n: int) -> DataFrame:
    return _top(summary.where(delta() > 0), delta(), n, "dir")


def shrinking_dirs(summary: DataFrame, n: int) -> DataFrame:
    return _top(summary.where(delta() < 0), -delta(), n, "dir")


def block_dirs(summary: DataFrame, n: int) -> DataFrame:
    return _top(summary.where((delta() == 0) & (block_delta() != 0)), F.abs(block_delta()), n, "dir")


def no_growth(summary: DataFrame) -> DataFrame:
    """Directories that changed without net growth."""
    return summary.where(is_changed() & (delta() == 0))


def _placed(changed: DataFrame, dirs_after: DataFrame) -> DataFrame:
    """Files with the place of their directory in the newer source; wholly removed directories come last, by name."""
    rows = changed.join(dirs_after.select("dir", "ord"), "dir", "left")
    zero = F.lit(0).cast(U64)
    return rows.select("dir", "name", F.coalesce("old", zero).alias("old"), F.coalesce("new", zero).alias("new"), "kind", F.col("ord").isNull().alias("gone"), F.coalesce("ord", F.lit(0)).alias("place"))


TIES = ("gone", "place", "dir", "name")


def largest_files(changed: DataFrame, dirs_after: DataFrame, n: int) -> DataFrame:
    return _top(_placed(changed.where("new > 0"), dirs_after), wide("new"), n, *TIES)


def increases(changed: DataFrame, dirs_after: DataFrame, n: int) -> DataFrame:
    rows = _placed(changed.where("coalesce(new, 0) > coalesce(old, 0)"), dirs_after)
    return _top(rows, wide("new") - wide("old"), n, *TIES)


def decreases(changed: DataFrame, dirs_after: DataFrame, n: int) -> DataFrame:
    rows = _placed(changed.where("coalesce(new, 0) < coalesce(old, 0)"), dirs_after)
    return _top(rows, wide("old") - wide("new"), n, *TIES)
