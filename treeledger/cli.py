"""Command line: ``python -m treeledger [report|export] [options] AFTER | BEFORE AFTER``."""

from __future__ import annotations

import argparse
import math
import sys
import time

from pyspark.sql import SparkSession

from .functions.text import memory_size
from .plans.report import Options, analyze, render
from .schema import SnapshotError
from .sources import FORMATS, load, sinks

VERSION = "0.1.0"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise SnapshotError(message)


#: What each output can be made of, and whether it needs a file of its own.
OUTPUTS = {"text": (FORMATS, False), "tsv": (("ls", "find"), False), "parquet": (("ls", "find"), True), "sqlite": (("ls", "find", "parquet"), True)}
#: The options that shape a report, their defaults, and the test that a given value has to pass.
REPORTING = {
    "depth": (int, 1, lambda v: v >= 1, "is a whole number from 1"),
    "top": (int, 10, lambda v: 1 <= v <= 1000, "is a whole number from 1 to 1000"),
    "block_size": (int, 1024, lambda v: v >= 1, "is a whole number of bytes from 1"),
    "days": (float, None, lambda v: 0 < v < math.inf, "is a finite number above 0"),
}


def parse(argv: list[str]) -> argparse.Namespace:
    """Options, checked against each other."""
    mode = argv[0] if argv[:1] in (["report"], ["export"]) else "legacy"
    p = _Parser(prog="treeledger", allow_abbrev=False)
    p.add_argument("inputs", nargs="*")
    for name, (kind, *_) in REPORTING.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind)
    p.add_argument("--include-merged", action="store_true")
    p.add_argument("--format", choices=OUTPUTS)
    p.add_argument("--input-format", default="ls", choices=FORMATS)
    p.add_argument("--source", default="ls", choices=("ls", "find"))
    p.add_argument("--output")
    p.add_argument("--duckdb-memory-limit", type=memory_size, help="checked and accepted; Spark's own memory settings hold")
    p.add_argument("--sqlite3-bin", help="accepted; no client is run")
    p.add_argument("--duckdb-bin", help="accepted; no client is run")
    p.add_argument("-V", "--version", action="version", version=f"treeledger {VERSION}")
    o = p.parse_args(argv if mode == "legacy" else argv[1:])
    o.mode = mode
    _settle(o)
    return o


def _settle(o: argparse.Namespace) -> None:
    """Fills in what wasn't given and refuses what doesn't fit together."""

    def need(holds: bool, message: str) -> None:
        if not holds:
            raise SnapshotError(message)

    shaped = [f"--{name.replace('_', '-')}" for name in REPORTING if getattr(o, name) is not None] + ["--include-merged"] * o.include_merged
    if o.mode == "report":
        need(o.format is None, "a report has no --format")
    elif o.mode == "export":
        need(not shaped, f"{' '.join(shaped)}: for reports only")
        need(o.format != "text", "an export is tsv, parquet or sqlite")
    if o.source == "find":
        need(o.input_format in ("ls", "find"), f"--source find and --input-format {o.input_format} contradict each other")
        o.input_format = "find"
    o.format = o.format or ("tsv" if o.mode == "export" else "text")
    made_of, filed = OUTPUTS[o.format]
    need(o.input_format in made_of, f"{o.format} is made of {' or '.join(made_of)} input")
    need(bool(o.output) if filed else o.output is None or o.format != "text", "--output is needed" if filed else "a report goes to standard output, without --output")
    need(1 <= len(o.inputs) <= (2 if o.format == "text" else 1), "inputs: one snapshot, or for a report two, the older first")
    need(o.inputs.count("-") <= (o.input_format in ("ls", "find", "tsv")), "one text input at most can come from standard input")
    need(o.duckdb_memory_limit is None or "parquet" in (o.format, o.input_format) or o.input_format == "duckdb", "--duckdb-memory-limit fits Parquet and DuckDB only")
    need(o.days is None or len(o.inputs) == 2, "--days needs two snapshots")
    for name, (_, usual, fits, what) in REPORTING.items():
        given = getattr(o, name)
        need(given is None or fits(given), f"--{name.replace('_', '-')} {what}")
        setattr(o, name, usual if given is None else given)


def options(o: argparse.Namespace) -> Options:
    """The options of a report."""
    return Options(o.inputs, o.depth, o.top, o.block_size, o.include_merged, o.days, o.input_format)


def run(o: argparse.Namespace, spark: SparkSession, out) -> None:
    if o.format == "text":
        out.write(render(analyze(spark, options(o))).encode())
        return
    began = time.monotonic()
    if o.output:
        print(f"started: export {o.format} -> {o.output}", file=sys.stderr)
    rows = load(spark, o.inputs[0], o.input_format, report=False).persist()
    bad = rows.where("record = 'unparsed'").count()
    if bad:
        print(f"warning: {bad} unparsed lines", file=sys.stderr)
    if o.output:
        sinks.WRITERS[o.format](rows, o.output)
        print(f"finished: export {o.format} -> {o.output} ({time.monotonic() - began:.3f}s)", file=sys.stderr)
    else:
        sinks.write_tsv_stream(rows, out)


def main(argv: list[str] | None = None) -> int:
    try:
        o = parse(sys.argv[1:] if argv is None else argv)
        spark = SparkSession.builder.appName("treeledger").config("spark.sql.ansi.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        run(o, spark, sys.stdout.buffer)
        sys.stdout.flush()
    except BrokenPipeError:
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
