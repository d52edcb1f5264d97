"""The report plans: capacity of one snapshot, comparison of two; their frames, and the text that shows them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import daily_growth, full_path, human, signed
from ..operators import compare as C
from ..operators.snapshot import Snapshot, read
from ..schema import SnapshotError
from ..sources import load


@dataclass
class Options:
    inputs: list[str] = field(default_factory=list)
    depth: int = 1
    top: int = 10
    block_size: int = 1024
    include_merged: bool = False
    days: float | None = None
    input_format: str = "ls"


@dataclass
class Analysis:
    """Lazy frames; views() names them for SQL.  changes and summary are kept, since every ranking reads them."""

    snapshots: list[Snapshot]
    changes: DataFrame
    summary: DataFrame
    options: Options
    relations: list[DataFrame] = field(default_factory=list)

    @property
    def comparing(self) -> bool:
        return len(self.snapshots) == 2

    @property
    def after(self) -> Snapshot:
        return self.snapshots[-1]

    def views(self) -> None:
        for name, frame in {"dirs": self.after.dirs, "files": self.after.files, "changes": self.changes, "directory_summary": self.summary}.items():
            frame.createOrReplaceTempView(name)

    def release(self) -> None:
        """Frees what analyze_rows has kept."""
        for frame in (self.changes, self.summary, *self.relations):
            frame.unpersist()

    def groups(self) -> DataFrame:
        return C.groups(self.summary, self.options.depth)


def analyze_rows(relations: list[DataFrame], options: Options) -> Analysis:
    relations = [r.persist() for r in relations]
    snapshots = [read(r, options.block_size, options.include_merged) for r in relations]
    for s in snapshots:
        s.validate()
        if s.dirs.groupBy("dir").count().where("count > 1").limit(1).count():
            raise SnapshotError("Duplicate directory in snapshot")
    before = snapshots[0] if len(snapshots) == 2 else None
    changed = C.changes(before and before.files, snapshots[-1].files).persist()
    if C.duplicates(changed).limit(1).count():
        raise SnapshotError("Duplicate file in snapshot")
    summary = C.directory_summary(changed, before and before.dirs, snapshots[-1].dirs).persist()
    return Analysis(snapshots, changed, summary, options, relations)


def analyze(spark: SparkSession, options: Options) -> Analysis:
    return analyze_rows([load(spark, p, options.input_format) for p in options.inputs], options)



def render(a: Analysis) -> str:
    """The report.  Only rankings and totals are collected."""
    o, both = a.options, a.comparing
    named = lambda df: df.withColumn("path", full_path(F.col("dir"), F.col("name"))).collect()
    t = C.total(a.summary).first()
    d = lambda r: int(r["new_bytes"]) - int(r["old_bytes"])
    b = lambda r: int(r["new_blocks"]) - int(r["old_blocks"])
    h = lambda r, c: human(int(r[c]))
    out = ["ls -lR directory analysis"]
    labels = ["before", "after"] if both else ["after"]
    out += [f"  {label}: {path}" for label, path in zip(labels, o.inputs, strict=True)]
    if both:
        out += [
            f"\nTotal regular-file size: {h(t, 'old_bytes')} → {h(t, 'new_bytes')} ({signed(d(t))})",
            f"Files: {t['old_files']} → {t['new_files']} | Directories: {t['old_dirs']} → {t['new_dirs']}",
            f"Added {t['added']} / removed {t['removed']} / resized {t['resized']} / same-size timestamp changes {t['mtime_only']} / other attribute changes {t['attrs_only']}",
            f"Size change: new files {h(t, 'added_bytes')} + existing growth {h(t, 'grown_bytes')} - removed {h(t, 'removed_bytes')} - existing shrinkage {h(t, 'shrunk_bytes')}",
            f"ls block total: {h(t, 'old_blocks')} → {h(t, 'new_blocks')} ({signed(b(t))})",
        ]
        if o.days is not None:
            days = f"{o.days:g}" if o.days != int(o.days) else f"{int(o.days)}"
            out.append(f"Average net growth over {days} days: {daily_growth(d(t), o.days)}/day (user-supplied interval, not a forecast)")
    else:
        out += [f"\nRegular-file size {h(t, 'new_bytes')} | Files {t['new_files']} | Directories {t['new_dirs']} | Symlinks {t['new_links']}", f"ls block total: {h(t, 'new_blocks')}"]
    grouped = a.groups().persist()
    count = grouped.count()
    out += [f"\nPath summary (depth {o.depth}, descendants included; each file counted once)", f"  {'Current size':>12} {'Change':>12} {'Block change':>12}  {'Files':>10}  Path"]
    for r in C.top_groups(grouped, o.top, both).collect():
        change, block = (signed(d(r)), signed(b(r))) if both else ("—", "—")
        out.append(f"  {h(r, 'new_bytes'):>12} {change:>12} {block:>12}  {r['new_files']:>10}  {r['path']}")
    if count > o.top:
        out.append(f"  {count - o.top} more paths omitted (adjust --top)")
    grouped.unpersist()
    if not both:
        out.append("\nLargest directories (direct files only; descendants excluded)")
        out += [f"  {h(r, 'new_bytes'):>12}  files {r['new_files']:>8}  {r['dir']}" for r in C.largest_dirs(a.summary, o.top).collect()]
    else:
        out.append("\nDirectory file-count changes (direct regular files; rough inode-count indicator)")
        rows = C.count_dirs(a.summary, o.top).collect()
        out += [f"  {int(r['new_files']) - int(r['old_files']):+10} files  {r['old_files']} → {r['new_files']} | size {signed(d(r))}  {r['dir']}" for r in rows] or ["  None"]
        for title, rank in (("Growing directories", C.growing_dirs), ("Shrinking directories", C.shrinking_dirs)):
            out.append(f"\n{title} (direct files only; descendants excluded)")
            rows = rank(a.summary, o.top).collect()
            for r in rows:
                out.append(f"  {signed(d(r)):>12}  added {r['added']:>6} / removed {r['removed']:>6} / resized {r['resized']:>5}  {r['dir']}")
                out.append(f"{'':16}new files {h(r, 'added_bytes')} / existing growth {h(r, 'grown_bytes')} / removed {h(r, 'removed_bytes')} / existing shrinkage {h(r, 'shrunk_bytes')}")
            out += [] if rows else ["  None"]
        for title, rank in (("Largest file increases", C.increases), ("Largest file decreases and removals", C.decreases)):
            out.append(f"\n{title}")
            rows = named(rank(a.changes, a.after.dirs, o.top))
            label = lambda r: r["kind"] if r["kind"] in ("added", "removed") else "resized"
            out += [f"  {signed(int(r['new']) - int(r['old'])):>12}  {h(r, 'old')} → {h(r, 'new')} [{label(r)}] {r['path']}" for r in rows] or ["  None"]
        out.append(f"\nChanged directories with no net size growth: {C.no_growth(a.summary).count()} (includes rotation, replacement, timestamp, attribute, and block changes)")
        rows = C.block_dirs(a.summary, o.top).collect()
        if rows:
            out.append("\nDirectories with block changes but no net file-size change (direct totals)")
            out += [f"  {signed(b(r)):>12}  {r['dir']}" for r in rows]
    out.append("\nLargest current files (capacity, not recent growth)")
    out += [f"  {h(r, 'new'):>12}  {r['path']}" for r in named(C.largest_files(a.changes, a.after.dirs, o.top))]
    out += [
        "\nNotes",
        f"  File sizes are logical regular-file sizes. ls total × {o.block_size} bytes; find total_bytes is already bytes.",
        "  Block totals include directories, links, and other entries. Hard-link sharing, shared blocks, and deleted open files cannot be identified.",
        "  Content changes with unchanged size and displayed timestamp are undetectable. Both listings must cover the same complete logical root.",
    ]
    if o.include_merged:
        out.append("  merged included: unified views can duplicate storage layers and overstate disk usage.")
    for label, s in zip(labels, a.snapshots, strict=True):
        g = s.diagnostics()
        if g["excluded_dirs"]:
            out.append(f"  {label}: overlay merged excluded: {g['excluded_dirs']} directories / {g['excluded_files']} files / {human(int(g['excluded_bytes']))}")
        if g["malformed"] + g["errors"] + g["missing_total"]:
            out.append(f"  Warning {label}: {g['malformed']} unparsed lines / {g['errors']} ls errors / {g['missing_total']} directories without totals; results may be incomplete")
            out += [f"    {e}" for e in g["examples"]]
    return "\n".join(out) + "\n"
