"""The snapshot operators over the driver's tables: adapters that turn tables into snapshots, queries and their SQL.

* lineitem: a file per supplier, order, line and part; two sides with changed sizes, stamps and attributes.
* documents: a file per document in lang/source; their text feeds the codecs, renderings of them the parsers.
* pages: paths of URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import compare as C
from .operators.order import carry_forward
from .operators.snapshot import read
from .runtime import checkpoint_dir
from .schema import COUNTERS, SNAPSHOT, U64
from .sources.artifacts import restored
from .sources.text import find_totals, number_rows, orphans, parse_find, parse_listing, parse_tsv
from .sources.sinks import tsv_lines

TOP = 25


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).cast("long").alias(c) for c in df.columns])


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """A row per file of the lineitem tree; both sides and their directories are made of this one table."""
    rows = _table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    checkpoint_dir(spark)
    return rows.agg((F.sum(F.col("l_quantity").cast("long")) * 1000).alias("size"), F.min("l_returnflag").alias("stamp"), F.min("l_linestatus").alias("attrs")).checkpoint()


def _files(base: DataFrame, side: str) -> DataFrame:
    """dir, name, size, stamp, attrs and supplier of one side of the lineitem tree."""
    rows = base.where("l_orderkey % 10 <> 0" if side == "before" else "l_orderkey % 10 <> 1")
    k, size, stamp, attrs = F.col("l_orderkey"), F.col("size"), F.col("stamp"), F.col("attrs")
    if side == "after":
        size = size + F.when(k % 7 == 0, (k % 5 - 2) * 100).otherwise(0)
        stamp, attrs = F.when(k % 11 == 0, "touched").otherwise(stamp), F.when(k % 13 == 0, "x").otherwise(attrs)
    return rows.select(F.concat(F.lit("w"), F.col("l_suppkey") % 10, F.lit("/s"), "l_suppkey").alias("dir"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("name"), size.cast(U64).alias("size"), stamp.alias("stamp"), attrs.alias("attrs"), F.col("l_suppkey").alias("supplier"))


def _dirs(files: DataFrame, side: str) -> DataFrame:
    more = F.col("supplier") % 3 * 1024 if side == "after" else F.lit(0)
    return files.groupBy("dir", "supplier").agg(F.count(F.lit(1)).alias("n")).select("dir", F.col("supplier").alias("ord"), (F.col("n") * 4096 + more).cast(U64).alias("blocks"), (F.col("supplier") % 2).alias("links"))


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """changes, directory summary, files and directories of the newer side."""
    base = _base(spark, sf)
    before, after = _files(base, "before"), _files(base, "after")
    changed = C.changes(before, after)
    return changed, C.directory_summary(changed, _dirs(before, "before"), _dirs(after, "after")), after, _dirs(after, "after")


def _single(spark: SparkSession, sf: str) -> DataFrame:
    after = _files(_base(spark, sf), "after")
    return C.directory_summary(C.changes(None, after), None, _dirs(after, "after"))


_SQL_FILES = """
base AS (SELECT l_suppkey AS supplier, l_orderkey AS k, 'w' || (l_suppkey % 10) || '/s' || l_suppkey AS dir, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS name,
  SUM(CAST(l_quantity AS BIGINT)) * 1000 AS size, MIN(l_returnflag) AS stamp, MIN(l_linestatus) AS attrs FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber, l_partkey),
b AS (SELECT dir, name, size, stamp, attrs, supplier FROM base WHERE k % 10 <> 0),
a AS (SELECT dir, name, size + CASE WHEN k % 7 = 0 THEN (k % 5 - 2) * 100 ELSE 0 END AS size, CASE WHEN k % 11 = 0 THEN 'touched' ELSE stamp END AS stamp, CASE WHEN k % 13 = 0 THEN 'x' ELSE attrs END AS attrs, supplier FROM base WHERE k % 10 <> 1),
bd AS (SELECT dir, supplier, count(*) * 4096 AS blocks, supplier % 2 AS links FROM b GROUP BY dir, supplier),
ad AS (SELECT dir, supplier, count(*) * 4096 + supplier % 3 * 1024 AS blocks, supplier % 2 AS links FROM a GROUP BY dir, supplier)"""


def _sql_pair(single: bool = False) -> str:
    before = "(SELECT * FROM b WHERE false)" if single else "b"
    before_dirs = "(SELECT * FROM bd WHERE false)" if single else "bd"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("added", "removed", "resized", "mtime_only", "attrs_only"))
    return f"""WITH {_SQL_FILES},
ch AS (SELECT coalesce(x.dir, a.dir) AS dir, coalesce(x.name, a.name) AS name, x.size AS old, a.size AS new,
  CASE WHEN x.dir IS NULL THEN 'added' WHEN a.dir IS NULL THEN 'removed' WHEN x.size <> a.size THEN 'resized' WHEN x.stamp <> a.stamp THEN 'mtime_only' WHEN x.attrs <> a.attrs THEN 'attrs_only' ELSE 'same' END AS kind
  FROM {before} x FULL JOIN a ON x.dir = a.dir AND x.name = a.name),
f AS (SELECT dir, count(old) AS old_files, count(new) AS new_files, coalesce(sum(old), 0) AS old_bytes, coalesce(sum(new), 0) AS new_bytes, {counts},
  coalesce(sum(new) FILTER (kind = 'added'), 0) AS added_bytes, coalesce(sum(old) FILTER (kind = 'removed'), 0) AS removed_bytes,
  coalesce(sum(new - old) FILTER (kind = 'resized' AND new > old), 0) AS grown_bytes, coalesce(sum(old - new) FILTER (kind = 'resized' AND new < old), 0) AS shrunk_bytes FROM ch GROUP BY dir),
w AS (SELECT f.*, CASE WHEN x.dir IS NULL THEN 0 ELSE 1 END AS old_dirs, CASE WHEN ad.dir IS NULL THEN 0 ELSE 1 END AS new_dirs, coalesce(x.links, 0) AS old_links, coalesce(ad.links, 0) AS new_links, coalesce(x.blocks, 0) AS old_blocks, coalesce(ad.blocks, 0) AS new_blocks
  FROM f LEFT JOIN {before_dirs} x ON x.dir = f.dir LEFT JOIN ad ON ad.dir = f.dir),
s AS (SELECT dir, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTERS)} FROM w),
g AS (SELECT split_part(dir, '/', 1) AS path, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)} FROM s GROUP BY 1)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ALL = ", ".join(COUNTERS)


@_query(f"{_sql_pair()} SELECT dir, name, CAST(coalesce(old, 0) AS BIGINT) AS old, CAST(coalesce(new, 0) AS BIGINT) AS new, kind FROM ch")
def compare_changes(spark, sf):
    side = lambda c: F.coalesce(c, F.lit(0).cast(U64)).alias(c)
    return _long(_pair(spark, sf)[0].select("dir", "name", side("old"), side("new"), "kind"), "dir", "name", "kind")


@_query(f"{_sql_pair()} SELECT dir, {_ALL} FROM s")
def compare_dir_summary(spark, sf):
    return _long(_pair(spark, sf)[1], "dir")


@_query(f"{_sql_pair()} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)}, true AS balanced FROM s")
def compare_total(spark, sf):
    t = C.total(_pair(spark, sf)[1])
    wide = C.wide
    return _long(t.withColumn("balanced", C.delta() == wide("added_bytes") + wide("grown_bytes") - wide("removed_bytes") - wide("shrunk_bytes")), "balanced")


@_query(f"{_sql_pair()} SELECT path, {_ALL}, abs(new_bytes - old_bytes) AS score FROM g ORDER BY score DESC, path LIMIT 5")
def compare_groups_topk(spark, sf):
    return _long(C.top_groups(C.groups(_pair(spark, sf)[1], 1), 5, True), "path")


@_query(f"{_sql_pair(True)} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)} FROM s")
def capacity_total(spark, sf):
    return _long(C.total(_single(spark, sf)))


@_query(f"{_sql_pair(True)} SELECT dir, new_files, new_bytes, new_blocks, new_links FROM s")
def capacity_dirs(spark, sf):
    return _long(_single(spark, sf).select("dir", "new_files", "new_bytes", "new_blocks", "new_links"), "dir")


@_query(f"{_sql_pair(True)} SELECT path, {_ALL}, new_bytes AS score FROM g ORDER BY score DESC, path LIMIT 5")
def capacity_groups_topk(spark, sf):
    return _long(C.top_groups(C.groups(_single(spark, sf), 1), 5, False), "path")


def _rank(name: str, where: str, score: str, pick, single: bool = False) -> None:
    def f(spark, sf):
        return _long(pick(_single(spark, sf) if single else _pair(spark, sf)[1], TOP), "dir")

    f.__name__ = name
    _query(f"{_sql_pair(single)} SELECT dir, {_ALL}, {score} AS score FROM s WHERE {where} ORDER BY score DESC, dir LIMIT {TOP}")(f)


_rank("rank_growing_dirs", "new_bytes > old_bytes", "new_bytes - old_bytes", C.growing_dirs)
_rank("rank_shrinking_dirs", "new_bytes < old_bytes", "old_bytes - new_bytes", C.shrinking_dirs)
_rank("rank_count_dirs", "new_files <> old_files", "abs(new_files - old_files)", C.count_dirs)
_rank("rank_largest_dirs", "new_files > 0", "new_bytes", C.largest_dirs, single=True)

_PLACED = "SELECT ch.dir, ch.name, CAST(coalesce(old, 0) AS BIGINT) AS old, CAST(coalesce(new, 0) AS BIGINT) AS new, kind, ad.dir IS NULL AS gone, coalesce(ad.supplier, 0) AS place, CAST({score} AS BIGINT) AS score FROM ch LEFT JOIN ad ON ad.dir = ch.dir WHERE {where} ORDER BY score DESC, gone, place, ch.dir, ch.name LIMIT " + str(TOP)


def _rank_files(name: str, where: str, score: str, pick) -> None:
    def f(spark, sf):
        changed, _, _, dirs = _pair(spark, sf)
        return _long(pick(changed, dirs, TOP), "dir", "name", "kind", "gone")

    f.__name__ = name
    _query(_sql_pair() + _PLACED.format(where=where, score=score))(f)


_rank_files("rank_largest_files", "new > 0", "new", C.largest_files)
_rank_files("rank_increases", "coalesce(new, 0) > coalesce(old, 0)", "coalesce(new, 0) - coalesce(old, 0)", C.increases)
_rank_files("rank_decreases", "coalesce(new, 0) < coalesce(old, 0)", "coalesce(old, 0) - coalesce(new, 0)", C.decreases)


def _block_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Directory counters of the documents tree against itself, with some attributes and block totals changed."""
    docs = _table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "source").alias("dir"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").cast(U64).alias("size"), F.lit("").alias("stamp"), F.when(F.col("doc_id") % 11 == 0, "b").otherwise("a").alias("attrs"), F.substring("source", 4, 9).cast("long").alias("supplier"))
    before = docs.withColumn("attrs", F.lit("a"))
    return C.directory_summary(C.changes(before, docs), _dirs(docs, "before"), _dirs(docs, "after"))


_SQL_BLOCKS = "WITH t AS (SELECT lang || '/' || source AS dir, CAST(substr(source, 4) AS BIGINT) AS k, count(*) AS n, count(*) FILTER (doc_id % 11 = 0) AS attrs_only FROM documents GROUP BY 1, 2)"


@_query(f"{_SQL_BLOCKS} SELECT dir, n * 4096 AS old_blocks, n * 4096 + k % 3 * 1024 AS new_blocks, k % 3 * 1024 AS score FROM t WHERE k % 3 > 0 ORDER BY score DESC, dir LIMIT {TOP}")
def rank_block_dirs(spark, sf):
    return _long(C.block_dirs(_block_summary(spark, sf), TOP).select("dir", "old_blocks", "new_blocks", "score"), "dir")


@_query(f"{_SQL_BLOCKS} SELECT dir, attrs_only, k % 3 * 1024 AS block_delta FROM t WHERE attrs_only > 0 OR k % 3 > 0")
def no_growth_dirs(spark, sf):
    return _long(C.no_growth(_block_summary(spark, sf)).select("dir", "attrs_only", C.block_delta().alias("block_delta")), "dir")


def _set(name: str, pick, sql: str) -> None:
    def f(spark, sf):
        base = _base(spark, sf)
        return pick(C.changes(_files(base, "before"), _files(base, "after")))

    f.__name__ = name
    _query(f"WITH {_SQL_FILES} {sql}")(f)


_set("added_files", C.added, "SELECT dir, name FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dir = a.dir AND b.name = a.name)")
_set("removed_files", C.removed, "SELECT dir, name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.dir = a.dir AND b.name = a.name)")
_set("common_files", C.common, "SELECT dir, name FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.dir = a.dir AND b.name = a.name)")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("dir"), F.col("l_linenumber").cast("string").alias("name"), F.lit(1).cast(U64).alias("size"), F.lit("").alias("stamp"), F.lit("").alias("attrs"))
    return C.duplicates(C.changes(None, rows)).select(F.col("dir").cast("long").alias("l_orderkey"), F.col("name").cast("int").alias("l_linenumber"))


@_query("SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 <> 0)")
def missing_parents(spark, sf):
    directories = _table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"))
    return orphans(_table(spark, sf, "orders").select(F.col("o_custkey").alias("parent")), directories).select(F.col("parent").alias("o_custkey")).distinct()


_DOC_PLACE = "(CAST(substr(source, 4) AS BIGINT) * 10 + CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) * 10000000"


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The documents tree as listing lines: a header per lang/source, an entry per document, some broken lines."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.expr(_DOC_PLACE).alias("place"))
    heads = docs.groupBy("place").agg(F.first("lang").alias("lang"), F.first("source").alias("source"))
    head = heads.select(F.col("place").alias("row_index"), F.concat(F.lit("./"), "lang", F.lit("/"), "source", F.lit(":")).alias("value"))
    total = heads.select((F.col("place") + 1).alias("row_index"), F.concat(F.lit("total "), (F.col("place") / 10000000).cast("long").cast("string")).alias("value"))
    line = F.concat(F.lit("-rw-r--r--  1 u"), F.col("doc_id") % 7, F.lit(" g  "), "n_chars", F.lit(" Oct  1 12:00 doc  "), "doc_id")
    value = F.when(F.col("doc_id") % 50 == 7, "-rw-r--r-- 1 broken").when(F.col("doc_id") % 50 == 8, "ls: cannot open").otherwise(line)
    return head.unionByName(total).unionByName(docs.select((F.col("place") + 2 + F.col("doc_id")).alias("row_index"), value.alias("value")))


@_query("SELECT './' || lang || '/' || source AS directory, 'u' || doc_id % 7 AS owner, CAST(n_chars AS VARCHAR) AS size_or_device, 'doc  ' || doc_id AS name FROM documents WHERE doc_id % 50 NOT IN (7, 8)")
def ls_parse_roundtrip(spark, sf):
    return parse_listing(_doc_lines(spark, sf)).where("record = 'entry'").select("directory", "owner", "size_or_device", "name")


@_query("SELECT * FROM (VALUES (2, 'entry', '1,3', ''), (3, 'entry', '8,0', ''), (4, 'total', '', '12'), (5, 'total', '', '+7'), (6, 'unparsed', '', ''), (7, 'unparsed', '', ''), (1, 'directory', '', '')) t(row_index, record, size_or_device, total)")
def ls_device_and_total(spark, sf):
    lines = [".:", "crw-rw-rw- 1 root root 1,   3 Oct 1 12:00 null", "brw-rw---- 1 root disk 8, 0 Oct 1 12:00 a, b", "total 12", "합계 +7", "total 1 2", "total 99999999999999999999"]
    got = parse_listing(spark.createDataFrame(list(enumerate(lines, 1)), "row_index long, value string"))
    return got.select(F.col("row_index").cast("int").alias("row_index"), "record", "size_or_device", "total")


@_query("SELECT event_id, last_value(CASE WHEN event_id % 10 = 3 THEN event_type || event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward_directory(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("row_index"), "event_type")
    head = F.when(F.col("row_index") % 10 == 3, F.concat("event_type", F.col("row_index").cast("string")))
    return carry_forward(rows, head, "carried").select(F.col("row_index").alias("event_id"), "carried")


def _doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as snapshot rows with their text as names."""
    docs = _table(spark, sf, "documents")
    cells = {f.name: F.lit("") for f in SNAPSHOT} | {"row_index": F.col("doc_id") + 2, "record": F.lit("entry"), "directory": F.concat("lang", F.lit("/"), "source"), "permissions": F.lit("-rw-r--r--"), "size_or_device": F.col("n_chars").cast("string"), "name": F.col("text")}
    return docs.select(*[v.alias(c) for c, v in cells.items()])


@_query("SELECT doc_id + 2 AS row_index, lang || '/' || source AS directory, CAST(n_chars AS VARCHAR) AS size_or_device, md5(text) AS name_md5 FROM documents")
def tsv_escape_roundtrip(spark, sf):
    lines = tsv_lines(_doc_rows(spark, sf)).select("row_index", F.col("line").alias("value"))
    return parse_tsv(lines).select("row_index", "directory", "size_or_device", F.md5("name").alias("name_md5"))


@_query("SELECT doc_id + 2 AS row_index, 'entry' AS record, lang || '/' || source AS directory, CAST(n_chars AS VARCHAR) AS size_or_device FROM documents")
def scan_snapshot_rows(spark, sf):
    return restored(_doc_rows(spark, sf)).select("row_index", "record", "directory", "size_or_device")


@_query("SELECT doc_id, row_number() OVER (ORDER BY doc_id * 37 % 1009, doc_id) AS row_index FROM documents")
def row_index_restore(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 37 % 1009).alias("old"))
    return number_rows(rows, "old", "doc_id").select("doc_id", "row_index")


def _find_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    place = F.concat("lang", F.lit("/"), "source")
    col = lambda path, kind, size, blocks, target: [path.alias("path"), kind.alias("kind"), size.cast("string").alias("size"), blocks.cast("string").alias("blocks"), target.alias("target")]
    zero, none = F.lit(0), F.lit("")
    dirs = spark.range(1).select(*col(F.lit(""), F.lit("d"), zero, zero, none)).unionByName(docs.select("lang").distinct().select(*col(F.col("lang"), F.lit("d"), zero, F.lit(8), none))).unionByName(docs.select("lang", "source").distinct().select(*col(place, F.lit("d"), zero, F.lit(8), none)))
    link = F.col("doc_id") % 9 == 0
    files = docs.select(*col(F.concat(place, F.lit("/"), "doc_id"), F.when(link, "l").otherwise("f"), F.col("n_chars"), F.floor(F.col("n_chars") / 512) + 1, F.when(link, F.lit("to")).otherwise("")))
    records = number_rows(dirs.unionByName(files), "path")
    mark = F.when(F.col("kind") == "f", "-").otherwise(F.col("kind"))
    fields = F.array("path", "kind", "size", "blocks", F.concat(mark, F.lit("rw-r--r--")), F.lit("1"), F.lit("1000"), F.lit("1000"), F.lit("1759320000.5"), "target")
    return records.select("row_index", F.posexplode(fields).alias("k", "value")).select(((F.col("row_index") - 1) * 10 + F.col("k") + 1).alias("row_index"), "value")


@_query("SELECT './' || lang || '/' || source AS directory, doc_id || CASE WHEN doc_id % 9 = 0 THEN ' -> to' ELSE '' END AS name, CAST(n_chars AS VARCHAR) AS size_or_device, '1759320000.5' AS day FROM documents")
def find_roundtrip(spark, sf):
    return parse_find(_find_fields(spark, sf)).where("record = 'entry' and permissions not like 'd%'").select("directory", "name", "size_or_device", "day")


@_query("SELECT lang || '/' || source AS parent, CAST(sum((n_chars // 512 + 1) * 512) AS BIGINT) AS total_bytes FROM documents GROUP BY 1")
def find_direct_totals(spark, sf):
    blocks = (F.floor(F.col("n_chars") / 512) + 1).cast("string")
    rows = _table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "source").alias("parent"), X.scaled(X.u64(blocks), 512).alias("bytes"))
    return _long(find_totals(rows), "parent")


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '.' WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'n' || s_nationkey || '/s' || s_suppkey END AS below FROM supplier")
def relative_paths(spark, sf):
    path = F.when(F.col("s_suppkey") % 4 == 0, "/data").when(F.col("s_suppkey") % 4 == 3, F.concat(F.lit("/database/"), F.col("s_suppkey"))).otherwise(F.concat(F.lit("/data/n"), F.col("s_nationkey"), F.lit("/s"), F.col("s_suppkey")))
    return _table(spark, sf, "supplier").select("s_suppkey", X.relative(path, F.lit("/data")).alias("below"))


def _overlay() -> Column:
    k = F.col("s_suppkey")
    return F.concat(F.when(k % 2 == 0, "./containers/storage/overlay/").otherwise("./containers/storage/"), k, F.when(k % 3 == 0, "/merged").when(k % 3 == 1, "/merged/usr").otherwise("/mergedness"))


@_query("SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 2 AS merged FROM supplier")
def overlay_excluded(spark, sf):
    return _table(spark, sf, "supplier").select("s_suppkey", X.is_merged(_overlay()).alias("merged"))


def _bucket(depth: int) -> None:
    def f(spark, sf):
        path = F.regexp_replace("url", "^[a-z]+://", "")
        return _table(spark, sf, "pages").groupBy(X.bucket(path, depth).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))

    f.__name__ = f"path_bucket_d{depth}"
    _query(f"SELECT array_to_string(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1:{depth}], '/') AS path, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")(f)


for _depth in (1, 2, 3):
    _bucket(_depth)


@_query("SELECT count(*) FILTER (doc_id % 50 = 7) AS malformed, count(*) FILTER (doc_id % 50 = 8) AS errors, CAST(0 AS BIGINT) AS missing_total, count(DISTINCT lang || source) AS dirs, count(*) FILTER (doc_id % 50 NOT IN (7, 8)) AS files, CAST(sum(n_chars) FILTER (doc_id % 50 NOT IN (7, 8)) AS BIGINT) AS bytes FROM documents")
def diagnostics_counts(spark, sf):
    first = spark.createDataFrame([(-2, ".:"), (-1, "total 0")], "row_index long, value string")
    s = read(parse_listing(first.unionByName(_doc_lines(spark, sf))))
    bad = s.problems.agg(F.sum("malformed").alias("malformed"), F.sum("errors").alias("errors"))
    sizes = s.files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))
    dirs = s.dirs.where("dir <> '.'").agg(F.count(F.lit(1)).alias("dirs"))
    return bad.join(s.excluded.select(F.col("missing_total").cast("long").alias("missing_total")), F.lit(True)).join(dirs, F.lit(True)).join(sizes, F.lit(True)).select("malformed", "errors", "missing_total", "dirs", "files", "bytes")  # one row each


_CENTS = "(CASE WHEN 2 * (n * 100 % {s}) > {s} OR (2 * (n * 100 % {s}) = {s} AND (n * 100 // {s}) % 2 = 1) THEN 1 ELSE 0 END + n * 100 // {s})"
_UNITS = " ".join(f"WHEN n >= {1 << p} THEN ({_CENTS.format(s=1 << p)} // 100) || '.' || lpad(CAST({_CENTS.format(s=1 << p)} % 100 AS VARCHAR), 2, '0') || ' {u}'" for u, p in (("GiB", 30), ("MiB", 20), ("KiB", 10)))


@_query(f"SELECT l_orderkey, l_linenumber, l_partkey, n, CASE {_UNITS} ELSE n || ' B' END AS shown FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey * (l_orderkey % 3 * 1000 + 1) * 32 AS n FROM lineitem)")
def human_sizes(spark, sf):
    n = F.col("l_partkey") * (F.col("l_orderkey") % 3 * 1000 + 1) * 32
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n")).distinct().withColumn("shown", X.human_column(F.col("n")))


@_query(f"{_sql_pair()} SELECT dir, CAST(round((new_bytes - old_bytes) / 7.0) AS BIGINT) AS per_day FROM s")
def daily_growth(spark, sf):
    return _pair(spark, sf)[1].select("dir", X.daily_bytes(C.delta(), 7).cast("long").alias("per_day"))
