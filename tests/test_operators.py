"""Operators on frames: comparison, roll-ups, rankings, ordered reading and column expressions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from treeledger.functions import text as X
from treeledger.operators import compare as C
from treeledger.operators.order import carry_forward, read_ordered
from treeledger.operators import order
from treeledger.schema import SNAPSHOT, U64
from treeledger.streaming.watch import watch

FILES = "dir string, name string, size decimal(20,0), stamp string, attrs string"
DIRS = "dir string, ord long, blocks decimal(20,0), links long"


def files(spark, *rows):
    """(dir, name, size) or (dir, name, size, (stamp, attrs))."""
    return spark.createDataFrame([(*r[:2], Decimal(r[2]), *(r[3] if len(r) > 3 else ("t", "a"))) for r in rows], FILES)


def dirs(spark, *rows):
    """(dir, ord, blocks, links)."""
    return spark.createDataFrame([(d, k, Decimal(b), n) for d, k, b, n in rows], DIRS)


def test_changes_take_the_first_difference(spark):
    before = files(spark, ("d", "same", 1), ("d", "grown", 1), ("d", "touched", 1), ("d", "mode", 1), ("d", "gone", 7))
    after = files(spark, ("d", "same", 1), ("d", "grown", 5, ("u", "b")), ("d", "touched", 1, ("u", "b")), ("d", "mode", 1, ("t", "b")), ("d", "new", 9))
    got = {r["name"]: r["kind"] for r in C.changes(before, after).collect()}
    assert got == {"same": "same", "grown": "resized", "touched": "mtime_only", "mode": "attrs_only", "gone": "removed", "new": "added"}
    s = C.total(C.directory_summary(C.changes(before, after), None, dirs(spark, ("d", 1, 10, 2)))).first()
    assert int(s["new_bytes"]) - int(s["old_bytes"]) == int(s["added_bytes"] + s["grown_bytes"] - s["removed_bytes"] - s["shrunk_bytes"]) == 6
    assert (s["new_links"], s["new_blocks"], s["old_dirs"], s["new_dirs"]) == (2, 10, 0, 1)


def test_counters_hold_64_bits_and_no_more(spark):
    most = 2**64 - 1
    one = C.changes(None, files(spark, ("d", "a", most)))
    assert C.total(C.directory_summary(one, None, dirs(spark))).first()["new_bytes"] == most
    with pytest.raises(Exception, match="new_bytes overflow"):
        C.directory_summary(C.changes(None, files(spark, ("d", "a", most), ("d", "b", 1))), None, dirs(spark)).collect()


def test_empty_sides(spark):
    none, empty = files(spark), dirs(spark)
    assert C.changes(none, none).count() == 0
    assert C.total(C.directory_summary(C.changes(None, none), None, empty)).first()["new_files"] == 0


def test_blocks_without_growth(spark):
    one = files(spark, ("d", "a", 5))
    s = C.directory_summary(C.changes(one, one), dirs(spark, ("d", 1, 4096, 0)), dirs(spark, ("d", 1, 8192, 0)))
    assert C.block_dirs(s, 5).first()["score"] == 4096 and C.no_growth(s).count() == 1 and C.growing_dirs(s, 5).count() == 0


def test_groups_and_buckets(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a-b",), (".",), ("a//b",)], "p string")
    assert [tuple(r) for r in rows.select(X.bucket(F.col("p"), 1), X.bucket(F.col("p"), 2)).collect()] == [("a", "a/b"), ("a-b", "a-b"), (".", "."), ("a", "a/")]


def test_numbers_as_columns(spark):
    values = ["5", "+5", "007", "18446744073709551615", "18446744073709551616", " 5", "1e3", "-1", "", "9" * 60, None]
    got = [r[0] and int(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v string").select(X.u64(F.col("v"))).collect()]
    assert got == [5, 5, 7, 2**64 - 1, *[None] * 7]
    sizes = [0, 5, 1023, 1024, 1152, 1664, -1536, 10**9, 2**43 + 1, 2**62]
    shown = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(X.human_column(F.col("s"))).collect()]
    assert shown == [X.human(s) for s in sizes]


def test_cells_round_trip(spark):
    rng = random.Random(3)
    cells = ["", "\\", "a\\", "\\t", "\t\n\r\\", "x" * 200_000 + "\\", *("".join(rng.choice("\\tnr\t\n\rx") for _ in range(12)) for _ in range(200))]
    df = spark.createDataFrame([(c,) for c in cells], "c string").withColumn("e", X.encode_cell(F.col("c")))
    got = df.select("c", X.decode_cell(F.col("e")).alias("d"), X.valid_cell(F.col("e")).alias("v"), "e").collect()
    assert all(r["c"] == r["d"] and r["v"] and "\n" not in r["e"] for r in got)
    bad = spark.createDataFrame([("\\q",), ("a\\",), ("\\\\\\",)], "c string").select(X.valid_cell(F.col("c")))
    assert [r[0] for r in bad.collect()] == [False] * 3


def test_ordered_reading_over_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    path = tmp_path / "lines"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = read_ordered(spark, str(path)).orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["row_index"] for r in got] == list(range(1, 5001)) and [r["value"] for r in got] == lines


def test_values_carry_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(order, "STRETCH", 10)
    rows = spark.range(95).select(F.col("id").alias("row_index"))
    got = carry_forward(rows, F.when(F.col("row_index").isin(3, 4, 60), F.col("row_index")), "v").orderBy("row_index").collect()
    assert [r["v"] for r in got] == [None] * 3 + [3] + [4] * 56 + [60] * 35


def test_files_are_exchanged_once_and_summed_before(spark):
    before = spark.range(1000).select(F.concat(F.lit("d"), F.col("id") % 10).alias("dir"), F.col("id").cast("string").alias("name"), F.col("id").cast(U64).alias("size"), F.lit("t").alias("stamp"), F.lit("a").alias("attrs"))
    plan = C.directory_summary(C.changes(before, before), None, dirs(spark))._jdf.queryExecution().executedPlan().toString()
    # the files, their directories' partial sums, and those with the directories' own rows
    assert plan.count("Exchange hashpartitioning(dir#") == 3 and "RoundRobin" not in plan
    got = C.directory_summary(C.changes(before, before), None, dirs(spark)).agg(F.sum("new_bytes"), F.count("*")).first()
    assert (int(got[0]), got[1]) == (499_500, 10)


def test_consecutive_snapshots(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    for k, size in enumerate((5, 9)):
        rows = [(1, "directory", ".", *[""] * 10), (2, "total", ".", *[""] * 9, "4"), (3, "entry", ".", "-rw-r--r--", "1", "u", "g", str(size), "O", "1", "1", "f", "")]
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    seen = []
    q = watch(spark, str(folder), str(tmp_path / "c"), lambda before, after, a: seen.append((before is None, int(C.total(a.summary).first()["new_bytes"]))))
    assert q.awaitTermination(120)
    assert seen == [(True, 5), (False, 9)]
