"""Listings, find records and artifacts through to reports."""

import os
import sqlite3

import pytest

from treeledger import cli
from treeledger.functions.text import daily_growth, human, memory_size, signed
from treeledger.plans.report import Options, analyze, render
from treeledger.schema import COLUMNS, SnapshotError
from treeledger.sources import load, sinks

# A tree of recordings: one file grows, one is touched, one goes and two come; an empty directory goes, another one comes.
BEFORE = """/srv/music:
total 12
-rw-r--r-- 1 ann lab 700 Mar 3 08:15 cover.png

/srv/music/live:
total 20
-rw-r----- 1 ann lab 5000 Mar 3 08:15 concert.ogg
-rw-r--r-- 1 ann lab 640 Mar 3 08:15 setlist
-rw-r--r-- 1 ann lab 0 Mar 3 08:15 to do

/srv/music/empty:
total 0
"""
AFTER = """.:
total 12
-rw-r--r-- 1 ann lab 700 Mar 3 08:15 cover.png

./studio:
total 4
-rw-r--r-- 1 ann lab 260 May 9 21:40 demo.ogg

./live:
total 28
-rw-r--r-- 1 ann lab 0 May 9 21:40 to do
-rw-r--r-- 1 ann lab 1500 May 9 21:40 encore.ogg
-rw-r----- 1 ann lab 9000 May 9 21:40 concert.ogg
"""
OLD, NEW = 700 + 5000 + 640, 700 + 260 + 1500 + 9000


def find(*records):
    return b"".join(str(x).encode() + b"\0" for r in records for x in r)


def node(path, kind, size, blocks, when="1740989700.25", target=""):
    mark = "-" if kind == "f" else kind
    return (path, kind, size, blocks, f"{mark}rw-r--r--", 1, 1000, 1000, when, target)


@pytest.fixture
def place(tmp_path):
    def write(name, data):
        path = tmp_path / f"{len(os.listdir(tmp_path))}-{name}"  # Spark keeps frames by path
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return write


def report(spark, *paths, **options):
    return render(analyze(spark, Options(list(paths), **options)))


def rows(frame):
    return [tuple(r)[1:] for r in frame.orderBy("row_index").collect()]


def test_comparison(spark, place):
    text = report(spark, place("before.txt", BEFORE), place("after.txt", AFTER), top=3, depth=2, days=4.0)
    for line in (
        "Files: 4 → 5 | Directories: 3 → 3",
        "Added 2 / removed 1 / resized 1 / same-size timestamp changes 1 / other attribute changes 0",
        f"new files {human(260 + 1500)} + existing growth {human(9000 - 5000)} - removed 640 B - existing shrinkage 0 B",
        f"{human(OLD)} → {human(NEW)} ({signed(NEW - OLD)})",
        f"{human(32 << 10)} → {human(44 << 10)} ({signed(12 << 10)})",
        f"over 4 days: {daily_growth(NEW - OLD, 4.0)}/day",
        "1 more paths omitted",
        "[resized] live/concert.ogg",
        "[removed] live/setlist",
        "no net size growth: 1 ",
        "          +1 files  0 → 1 | size +260 B  studio",
    ):
        assert line in text
    assert "Warning" not in text
    lines = text.split("\n")
    at = lines.index("Largest file increases")
    assert [x.split()[-1] for x in lines[at + 1 : at + 4]] == ["live/concert.ogg", "live/encore.ogg", "studio/demo.ogg"]
    at = next(k for k, x in enumerate(lines) if x.startswith("Shrinking directories"))
    assert lines[at + 1] == "  None"


def test_capacity(spark, place):
    text = report(spark, place("after.txt", AFTER))
    assert f"Regular-file size {human(NEW)} | Files 5 | Directories 3 | Symlinks 0" in text
    assert "Largest file increases" not in text
    lines = text.split("\n")
    at = next(k for k, x in enumerate(lines) if x.startswith("Largest directories"))
    assert [x.split()[-1] for x in lines[at + 1 : at + 4]] == ["live", ".", "studio"]
    assert "to do" not in text


def test_listing_lines(spark, place):
    listing = "total 9\n.:\n합계 8\n-rw-r--r--+ 1 u g 5 Oct 1 12:00 file with spaces:\ncrw-rw-rw- 1 root root 1,   3 Oct 1 12:00 null\nlrwxrwxrwx 1 u g 3 Oct 1 12:00 a -> b\nls: cannot open x\n-rw-r--r-- 1 u\ntotal x\nodd\n\n./sub:\ntotal 3 extra\n"
    got = rows(load(spark, place("x.txt", listing), "ls", report=False))
    kinds = [r[0] for r in got]
    assert kinds == ["total", "directory", "total", "entry", "entry", "entry", "ls_error", "unparsed", "unparsed", "unparsed", "directory", "unparsed"]
    assert got[2][1] == "." and got[2][11] == "8"
    assert got[3][10] == "file with spaces:" and got[4][6] == "1,3" and got[5][10] == "a -> b"
    assert rows(load(spark, place("y.txt", listing), "ls"))[11][0] == "total"


def test_warnings_and_overlay(spark, place):
    listing = """.:
total 4
-rw-r--r-- 1 u g 10 Oct 1 12:00 a
garbage
-rw-r--r-- 1 u g many Oct 1 12:00 b
ls: no

./containers/storage/overlay/abc/merged:
total 4
-rw-r--r-- 1 u g 7 Oct 1 12:00 c

./containers:
"""
    path = place("x.txt", listing)
    text = report(spark, path)
    assert "after: overlay merged excluded: 1 directories / 1 files / 7 B" in text
    assert "Warning after: 2 unparsed lines / 1 ls errors / 1 directories without totals" in text
    assert "    garbage\n    -rw-r--r-- 1 u g many Oct 1 12:00 b" in text
    assert "Files 1 | Directories 2" in text
    assert "Files 2 | Directories 3" in report(spark, path, include_merged=True)


def test_tie_order_follows_the_newer_source(spark, place):
    before = "r:\ntotal 0\n"
    after = "r:\ntotal 0\n\nr/z:\ntotal 0\n-rw-r--r-- 1 u g 5 O 1 1 tie\n\nr/a:\ntotal 0\n-rw-r--r-- 1 u g 5 O 1 1 tie\n"
    text = report(spark, place("b", before), place("a", after))
    assert text.index("[added] z/tie") < text.index("[added] a/tie")


def test_root_forms_and_errors(spark, place):
    a = analyze(spark, Options([place("a", "/:\ntotal 0\n\n/a:\ntotal 0\n\n/a/b:\ntotal 0\n")]))
    assert sorted(r["dir"] for r in a.after.dirs.collect()) == [".", "a", "a/b"]
    for listing, message in (
        ("x:\ntotal 0\n\ny:\ntotal 0\n", "outside"),
        ("-rw-r--r-- 1 u g 5 O 1 1 f\n", "Entry before"),
        ("odd\n", "No directory headers"),
        ("x:\n-rw-r--r-- 1 u g 5 O 1 1 f\n-rw-r--r-- 1 u g 5 O 1 1 f\n", "Duplicate"),
        ("x:\n\nx:\n", "Duplicate"),
    ):
        with pytest.raises(SnapshotError, match=message):
            analyze(spark, Options([place("e", listing)]))


_CLOCK = "1746826800.5"
FIND_BEFORE = find(node("", "d", 0, 3), node("live", "d", 0, 8), node("live/concert.ogg", "f", 5000, 10), node("cover.png", "f", 700, 2), node("live/to do", "f", 0, 0), node("empty", "d", 0, 8), node("live/setlist", "f", 640, 2))
FIND_AFTER = find(node("", "d", 0, 3), node("cover.png", "f", 700, 2), node("studio", "d", 0, 8, _CLOCK), node("live", "d", 0, 8), node("studio/demo.ogg", "f", 260, 2, _CLOCK), node("live/encore.ogg", "f", 1500, 4, _CLOCK), node("live/concert.ogg", "f", 9000, 18, _CLOCK), node("live/to do", "f", 0, 0, _CLOCK))


def test_find_reports_like_listings(spark, place):
    text = report(spark, place("b", FIND_BEFORE), place("a", FIND_AFTER), input_format="find")
    assert "Files: 4 → 5 | Directories: 3 → 3" in text and "same-size timestamp changes 1" in text
    assert f"{human(30 * 512)} → {human(42 * 512)} ({signed(12 * 512)})" in text  # of all but the root itself
    got = rows(load(spark, place("c", FIND_BEFORE), "find"))
    assert got[:2] == [("directory", ".", *[""] * 10), ("total_bytes", ".", *[""] * 9, str(18 * 512))]
    assert [r[10] for r in got[2:5]] == ["live", "cover.png", "empty"]  # in source order
    assert [r[0] for r in got].count("entry") == 6 and got[5][1] == "./empty"


def test_find_rejects(spark, place):
    root = node("", "d", 0, 0)
    bad = [
        (find(root, node("a", "l", 1, 0, target="x"))[:-1], "Unterminated"),
        (find(root)[:-1], "Truncated"),
        (find(root) + b"x\0", "Truncated"),
        (find(root, node("../escape", "f", 1, 1)), "path"),
        (find(root, node("a/b", "f", 1, 1)), "Missing parent"),
        (find(root, node("a", "f", "NaN", 1)), "number"),
        (find(root, node("a", "f", 1, 1), node("a", "f", 1, 1)), "Duplicate"),
        (find(root, ("a", "f", 1, 1, "drw-r--r--", 1, 1, 1, "1.0", "")), "permissions"),
        (find(root, node("a", "f", 1, 1, "soon")), "time"),
        (find(root, node("a", "f", 1, 2**63)), "overflow"),
    ]
    for data, message in bad:
        with pytest.raises(SnapshotError, match=message):
            load(spark, place("f", data), "find").count()


def test_artifacts_agree(spark, place, tmp_path):
    names = find(node("", "d", 0, 0), node('q"t\ta\\b\nc', "f", 2**64 - 1, 8), node("한글", "l", 1, 0, target="x"))
    for k, (data, kind) in enumerate(((BEFORE.encode(), "ls"), (names, "find"))):
        source = place(f"s{k}", data)
        original = rows(load(spark, source, kind))
        paths = {f: str(tmp_path / f"o{k}.{f}") for f in ("tsv", "parquet", "sqlite")}
        for f, path in paths.items():
            assert cli.main(["export", "--input-format", kind, "--format", f, "--output", path, source]) == 0
            assert rows(load(spark, path, f)) == original
            assert cli.main(["export", "--input-format", kind, "--format", f, "--output", path, source]) == 1  # never over a file
        again = str(tmp_path / f"p{k}.sqlite")
        assert cli.main(["export", "--input-format", "parquet", "--format", "sqlite", "--output", again, paths["parquet"]]) == 0
        assert rows(load(spark, again, "sqlite")) == original
        import duckdb

        place_of_db = str(tmp_path / f"d{k}.duckdb")
        with duckdb.connect(place_of_db) as db:
            db.execute(f"CREATE TABLE snapshot AS SELECT * FROM '{paths['parquet']}'")
        assert rows(load(spark, place_of_db, "duckdb")) == original
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".treeledger")]


def test_shuffled_parquet_reports_the_same(spark, place, tmp_path):
    source = place("s", AFTER)
    frame = load(spark, source, "ls")
    spark.createDataFrame([(r["row_index"] - 5, *tuple(r)[1:]) for r in reversed(frame.orderBy("row_index").collect())], frame.schema).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert report(spark, str(tmp_path / "p"), input_format="parquet").split("\n")[2:] == report(spark, source).split("\n")[2:]


def test_bad_tables(spark, place, tmp_path):
    head = "\t".join(COLUMNS)
    for body, message in (("a\tb", "12 cells"), ("\\q" + "\t" * 11, "escape"), ("strange\tx" + "\t" * 10, "Unexpected"), ("directory\tx" + "\t" * 10 + "\nentry\ty" + "\t" * 10, "match")):
        with pytest.raises(SnapshotError, match=message):
            analyze(spark, Options([place("t", f"{head}\n{body}\n")], input_format="tsv"))
    with pytest.raises(SnapshotError, match="header"):
        load(spark, place("t", "x\n"), "tsv")
    path = str(tmp_path / "n.sqlite")
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE snapshot(row_index INTEGER PRIMARY KEY, {', '.join(f'"{c}" TEXT' for c in COLUMNS)})")
        db.execute(f"INSERT INTO snapshot VALUES (1, NULL{', NULL' * 11})")
    with pytest.raises(SnapshotError, match="NULL"):
        analyze(spark, Options([path], input_format="sqlite"))


def test_options():
    for argv in (["-", "-"], [], ["a", "b", "c"], ["--top", "0", "a"], ["--top", "1001", "a"], ["--days", "1", "a"], ["--days", "nan", "a", "b"], ["report", "--format", "tsv", "a"], ["export", "--depth", "2", "a"], ["export", "--format", "sqlite", "a"], ["--output", "x", "a"], ["--format", "duckdb", "a"], ["--input-format", "xml", "a"], ["--source", "find", "--input-format", "tsv", "a"], ["--wrong", "a"], ["export", "--input-format", "tsv", "a"], ["--input-format", "parquet", "-"]):
        with pytest.raises(SnapshotError):
            cli.parse(argv)
    o = cli.parse(["export", "--source", "find", "--format", "parquet", "--output", "x", "--duckdb-memory-limit", "512MiB", "a"])
    assert (o.mode, o.input_format, o.duckdb_memory_limit) == ("export", "find", 512 << 20)
    assert cli.parse(["--", "-x"]).inputs == ["-x"]


def test_numbers():
    assert [human(x) for x in (0, 1023, 1024, 1152, -1536, 5 << 40)] == ["0 B", "1023 B", "1.00 KiB", "1.12 KiB", "-1.50 KiB", "5.00 TiB"]
    assert (signed(0), signed(5), signed(-5)) == ("0 B", "+5 B", "-5 B")
    assert (daily_growth(1150, 3.0), daily_growth(1, 2.0), daily_growth(-1, 2.0)) == ("+383 B", "+1 B", "-1 B")
    assert memory_size("1GB") == 10**9
    for bad in ("", "5", "0B", "5 MB", "99999999999GiB", "-1B"):
        with pytest.raises(SnapshotError):
            memory_size(bad)


def test_sinks_refuse_long_rows(spark, place):
    long = place("l", "x:\n" + "y" * (200 << 10) + "\\" * (40 << 10) + "\n")
    with pytest.raises(Exception, match="exceeds its limit"):
        sinks.tsv_lines(load(spark, long, "ls")).collect()


def test_databases_without_index_and_short_reads(spark, place, tmp_path, monkeypatch):
    from treeledger.sources import artifacts

    source = place("s", AFTER)
    original = rows(load(spark, source, "ls"))
    kept = str(tmp_path / "k.sqlite")
    sinks.write_sqlite(load(spark, source, "ls"), kept)
    bare = str(tmp_path / "b.sqlite")
    with sqlite3.connect(bare) as db:  # no index, and gaps in row_index
        db.execute(f"ATTACH '{kept}' AS k")
        db.execute("CREATE TABLE snapshot AS SELECT * FROM k.snapshot ORDER BY row_index DESC")
        db.execute("UPDATE snapshot SET row_index = row_index * 1000000000")
    monkeypatch.setattr(artifacts, "RANGE_ROWS", 3)
    for path in (kept, bare):
        parts = artifacts.SnapshotReader("sqlite", path).partitions()
        assert len(parts) > 2 and sum(p.rows for p in parts) == len(original) and {p.by for p in parts} == {"rowid"}
        assert rows(load(spark, path, "sqlite")) == original
    reader = artifacts.SnapshotReader("sqlite", kept)
    whole = reader.partitions()[0]
    whole.rows += 1
    with pytest.raises(SnapshotError, match="rows came of"):
        list(reader.read(whole))


def test_line_limits(spark, place):
    from treeledger.schema import TEXT_LINE

    assert load(spark, place("l", ".:\n" + "x" * TEXT_LINE + "\n"), "ls").count() == 2
    with pytest.raises(SnapshotError, match="limit"):
        load(spark, place("l", ".:\n" + "x" * (TEXT_LINE + 1) + "\n"), "ls")
    with pytest.raises(SnapshotError, match="UTF-8"):
        load(spark, place("l", b".:\n\xc3\x28\r\n"), "ls")
