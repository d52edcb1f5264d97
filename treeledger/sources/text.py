"""Text snapshots: recursive listings, NUL-separated find records and TSV, as snapshot relations."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.order import carry_forward, read_ordered
from ..runtime import checkpoint_dir
from ..schema import COLUMNS, FIND_FIELD, FIND_RECORD, SNAPSHOT, TEXT_LINE, U64, U64_MAX, WIDE, SnapshotError


def spool(spark: SparkSession, path: str) -> str:
    """The path itself, or for - a file with what stands on standard input, in the shared folder; it goes with the session."""
    if path != "-":
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/stdin-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(place)
    out = fs.create(place)
    try:
        while data := sys.stdin.buffer.read(1 << 20):
            out.write(data)
    finally:
        out.close()
    return place.toString()


def _rows(frame: DataFrame) -> DataFrame:
    return frame.select([F.col(f"`{f.name}`").cast(f.dataType) for f in SNAPSHOT])


def _check(frame: DataFrame, problems: dict) -> None:
    """Raises the first problem (message: condition) that any row has; one pass."""
    if problems:
        found = frame.agg(*[F.count(F.when(c, 1)).alias(f"p{k}") for k, c in enumerate(problems.values())]).first()
        for k, message in enumerate(problems):
            if found[f"p{k}"]:
                raise SnapshotError(message)


def parse_listing(lines: DataFrame, report: bool = False) -> DataFrame:
    """Snapshot rows of listing lines (row_index, value).  report: a total line may hold more than two tokens."""
    value = F.col("value")
    lines = lines.where(value != "")
    joined = X.joined_device(value)
    entry, head = X.permissions_record(joined), X.is_header(value)
    is_total = F.startswith(value, F.lit("total ")) | F.startswith(value, F.lit("합계 "))
    number = F.regexp_extract(value, r"(?Us)^\S+\s+(\S+)" + (r".*$" if report else r"\s*$"), 1)
    kind = (
        F.when(entry, F.when(X.has_fields(joined), "entry").otherwise("unparsed"))
        .when(is_total, F.when(X.u64(number).isNotNull(), "total").otherwise("unparsed"))
        .when(F.startswith(value, F.lit("ls:")), "ls_error")
        .when(head, "directory")
        .otherwise("unparsed")
    )
    rows = carry_forward(lines.withColumns({"record": kind, "joined": joined}), F.when(F.col("record") == "directory", X.header(value)), "directory")
    cells = {c: F.when(F.col("record") == "entry", X.field(F.col("joined"), k)).otherwise("") for k, c in enumerate(COLUMNS[2:11], 1)}
    cells["name"] = F.when(F.col("record").isin("ls_error", "unparsed"), value).otherwise(cells["name"])
    cells["total"] = F.when(F.col("record") == "total", number).otherwise("")
    return _rows(rows.withColumns(cells | {"directory": F.coalesce("directory", F.lit(""))}))


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Snapshot rows of TSV lines (row_index, value), whose first is the header."""
    body = lines.where("row_index > 1").withColumn("cells", F.split("value", "\t", -1))
    _check(body, {"a TSV row needs 12 cells": F.size("cells") != 12, "unknown escape in a TSV cell": F.exists("cells", lambda c: ~X.valid_cell(c))})
    return _rows(body.select("row_index", *[X.decode_cell(F.col("cells")[k]).alias(c) for k, c in enumerate(COLUMNS)]))


def parse_find(fields: DataFrame) -> DataFrame:
    """Snapshot rows of find fields (row_index from 1, value): ten to a record; directories in path order."""
    ordinal = F.col("row_index") - 1
    names = ("path", "type", "size", "blocks", "permissions", "links", "uid", "gid", "epoch", "target")
    records = fields.groupBy(F.floor(ordinal / 10).alias("ordinal")).agg(*[F.max(F.when(ordinal % 10 == k, F.col("value"))).alias(c) for k, c in enumerate(names)])
    records = records.persist()
    kinds = F.create_map(*[F.lit(x) for pair in zip("fdlbcps", "-dlbcps") for x in pair])
    numbers = {c: X.u64(F.col(c)) for c in ("size", "blocks", "links", "uid", "gid")}
    bad_path = (F.col("path") != "") & F.exists(F.split("path", "/", -1), lambda p: p.isin("", ".", ".."))
    kind = F.when(F.length("type") == 1, F.element_at(kinds, F.col("type")))
    root = F.col("path") == ""
    _check(
        records,
        {
            "Truncated find record": F.greatest(*[F.col(c).isNull() for c in names]),
            "find field exceeds its limit": F.greatest(*[F.octet_length(c) for c in names]) > FIND_FIELD,
            "find record exceeds its limit": sum(F.octet_length(c) for c in names) > FIND_RECORD,
            "find path is not plain and relative": bad_path,
            "unknown find type": F.coalesce(F.col("type").isin(*"fdlbcps"), F.lit(False)) == F.lit(False),
            "find permissions don't fit the type": ~F.col("permissions").rlike(r"^[-dlbcps][-rwxsStT]{9}$") | (F.substring("permissions", 1, 1) != kind),
            "find number is no unsigned 64-bit integer": F.greatest(*[x.isNull() for x in numbers.values()]),
            "find time is not seconds with a fraction": ~F.col("epoch").rlike(r"^-?[0-9]+\.[0-9]+$"),
            "find root is not a directory": root & (F.col("type") != "d"),
            "find root is not the first record": root != (F.col("ordinal") == 0),
        },
    )
    if records.isEmpty():
        raise SnapshotError("No find records")
    if records.groupBy("path").count().where("count > 1").limit(1).count():
        raise SnapshotError("Duplicate find path")
    slash = F.col("path").contains("/")
    records = records.withColumns(
        {
            "parent": F.when(slash, F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).otherwise(""),
            "base": F.when(slash, F.substring_index("path", "/", -1)).otherwise(F.col("path")),
            "bytes": X.scaled(X.u64(F.col("blocks")), 512),
        }
    )
    directories = records.where("type = 'd'").select(F.col("path").alias("directory_path"), F.col("ordinal").alias("directory_ordinal"))
    children = records.where("path <> ''")
    if orphans(children, directories.withColumnRenamed("directory_path", "path")).limit(1).count():
        raise SnapshotError("Missing parent directory in find input")
    totals = find_totals(children)
    problem = totals.where(F.col("total_bytes").isNull()).limit(1).count()
    if problem:
        raise SnapshotError("Allocated size overflow")
    heads = directories.join(totals, directories["directory_path"] == totals["parent"], "left")
    empty = {c: F.lit("") for c in COLUMNS[2:]}
    place = X.snapshot_directory(F.col("directory_path"))
    head = heads.select(F.col("directory_path").alias("_path"), F.lit(-2).cast("long").alias("_at"), F.lit("directory").alias("record"), place.alias("directory"), *[v.alias(c) for c, v in empty.items()])
    total = heads.select(F.col("directory_path").alias("_path"), F.lit(-1).cast("long").alias("_at"), F.lit("total_bytes").alias("record"), place.alias("directory"), *[(v if c != "total" else F.coalesce("total_bytes", F.lit(0)).cast("string")).alias(c) for c, v in empty.items()])
    shown = F.when(F.col("type") == "l", F.concat("base", F.lit(" -> "), "target")).otherwise(F.col("base"))
    entries = children.select(
        F.col("parent").alias("_path"), F.col("ordinal").alias("_at"), F.lit("entry").alias("record"), X.snapshot_directory(F.col("parent")).alias("directory"), "permissions", "links", F.col("uid").alias("owner"), F.col("gid").alias("group"),
        F.col("size").alias("size_or_device"), F.lit("epoch").alias("month"), F.col("epoch").alias("day"), F.lit("find").alias("time_or_year"), shown.alias("name"), F.lit("").alias("total"),
    )
    return _rows(number_rows(head.unionByName(total).unionByName(entries), "_path", "_at"))


def orphans(children: DataFrame, directories: DataFrame) -> DataFrame:
    """The children whose parent is no path of directories."""
    return children.join(directories.select(F.col("path").alias("parent")), "parent", "left_anti")


def find_totals(children: DataFrame) -> DataFrame:
    """parent and total_bytes (allocated bytes of direct children; null beyond 64 bits)."""
    total = F.sum("bytes").cast(WIDE)
    return children.groupBy("parent").agg(F.when((total <= F.lit(str(U64_MAX)).cast(WIDE)) & (F.count("bytes") == F.count(F.lit(1))), total.cast(U64)).alias("total_bytes"))


def number_rows(rows: DataFrame, *order: str) -> DataFrame:
    """rows with row_index from 1 in the given order: a range sort, and the sizes of its partitions."""
    ordered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).persist()
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, first = 0, {}
    for part in sorted(sizes):
        first[part], before = before, before + sizes[part]
    if not first:
        return ordered.withColumn("row_index", F.lit(0).cast("long")).drop("_id", "_part")
    places = F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair])
    return ordered.withColumn("row_index", F.element_at(places, F.col("_part").cast("long")) + (F.col("_id") - F.shiftleft("_part", 33)) + 1).drop("_id", "_part")


def _last_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The end of a file, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(place).isDirectory():
        raise SnapshotError(f"{path} is a directory")
    size = fs.getFileStatus(place).getLen()
    stream = fs.open(place)
    try:
        stream.seek(max(0, size - n))
        return bytes(stream.read() for _ in range(min(n, size)))
    finally:
        stream.close()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without the carriage return of terminated ones; checks length and UTF-8."""
    raw = read_ordered(spark, path)
    _check(raw, {"line exceeds its limit": F.octet_length("value") > TEXT_LINE + 1, "input is not UTF-8": ~F.is_valid_utf8("value")})
    whole = _last_bytes(spark, path, 1) in (b"\n", b"")
    value = F.regexp_replace("value", r"\r\z", "")
    if not whole:
        last = raw.agg(F.max("row_index")).first()[0]
        value = F.when(F.col("row_index") == last, F.col("value")).otherwise(value)
    lines = raw.select("row_index", value.alias("value"))
    _check(lines, {"line exceeds its limit": F.octet_length("value") > TEXT_LINE})
    return lines


HEADER = "\t".join(COLUMNS)


def read_listing(spark: SparkSession, path: str, report: bool = False) -> DataFrame:
    """A listing, or TSV that begins with the header."""
    lines = _lines(spark, path)
    first = lines.where("row_index = 1").first()
    if first and first["value"].startswith("record\tdirectory\t"):
        return read_tsv(spark, path)
    return parse_listing(lines, report)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    first = lines.where("row_index = 1").first()
    if first is None:
        raise SnapshotError("Missing TSV header")
    if first["value"].rstrip("\r\n") != HEADER:
        raise SnapshotError("Invalid TSV header: expected the 12 snapshot columns")
    return parse_tsv(lines)


def read_find(spark: SparkSession, path: str) -> DataFrame:
    if _last_bytes(spark, path, 1) != b"\0":
        raise SnapshotError("Unterminated find field")
    fields = read_ordered(spark, path, "\0")
    _check(fields, {"input is not UTF-8": ~F.is_valid_utf8("value")})
    return parse_find(fields)
