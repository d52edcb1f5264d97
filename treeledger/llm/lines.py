"""Line dedup: fuzzy lines by MinHash over character shingles.

A line (between line ends, without the white space around it) is known by a 64-bit hash; its set holds its shingles of
``width`` characters (the line itself, if shorter).  The steps:

1. Each distinct line gets ``bands * rows`` minima of its shingles' hashes; lines that agree in a whole band are
   candidates.  At a similarity of 0.8 a pair is missed with probability (1 - 0.8**rows)**bands, below 0.002 here.
2. The lines that agree in a band are a group, taken once where several bands give the same lines; the exact Jaccard
   similarity of a group's pairs is checked, large groups in pairs of blocks.
3. Distributed union-find over the verified links gives components of lines; equal lines are one line from the start.
4. Of each component the first line in the document with the smallest doc_id stays.

Defined results: blank lines always stay and are counted nowhere; null and empty texts stay as they are; rows that repeat
a doc_id count as one document; a document may be left with an empty text; an empty table gives an empty result; other
columns pass through.  A row with a null doc_id loses only lines that stand earlier in it, and no other row loses a line
for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, jaccard, packed
from . import textbytes as tb

U64 = np.uint64
WIDTH, BANDS, ROWS = 8, 9, 3
#: Lines of a group in a block; places of wanted lines up to which they are broadcast (some tens of bytes each).
BLOCK_LINES, BROADCAST_LINES = 4000, 1_000_000
#: Lines up to which a group's overlaps are counted by a matrix product, and columns of it at once.
DENSE_LINES, DENSE_COLUMNS = 1024, 8192
#: Shingles whose hashes are computed at once.
RUN_SHINGLES = 1 << 15
_draw = np.random.default_rng(7)
_MULTIPLY = (_draw.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_LEAD = (np.arange(256) & 0xC0) != 0x80


def find_lines(s: tb.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without white space around), document and hash of each line with a word."""
    lo, hi, _ = s.words()
    line = np.searchsorted(np.flatnonzero(s.buf == 10), lo)
    at = packed.starts(line)
    first, last = lo[at], hi[np.append(at[1:], len(lo)) - 1] if len(at) else hi[:0]
    return first, last, s.document(first), s.hashes(first, last)


def _runs(cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """Lines in runs of about RUN_SHINGLES, whose temporary arrays stay in the processor's cache."""
    ends = np.unique(np.searchsorted(cut, np.arange(RUN_SHINGLES, cut[-1] + RUN_SHINGLES, RUN_SHINGLES))).clip(max=len(cut) - 1).tolist()
    yield from ((lo, hi) for lo, hi in zip([0, *ends], ends) if lo < hi)


def line_shingles(s: tb.Slice, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the lines, one line after the other, and where each line's begin (one more than lines)."""
    lead = np.flatnonzero(_LEAD[s.buf])
    edge = np.append(lead, len(s.buf))
    a, b = np.searchsorted(lead, first), np.searchsorted(lead, last)
    count = np.maximum(b - a - width + 1, 1)
    cut = np.concatenate([[0], np.cumsum(count)])
    out, plain = np.empty(cut[-1], U64), len(lead) == len(s.buf)
    for lo, hi in _runs(cut):
        at = np.arange(cut[lo], cut[hi]) - np.repeat(cut[lo:hi] - a[lo:hi], count[lo:hi])
        end = np.minimum(at + width, np.repeat(b[lo:hi], count[lo:hi]))
        out[cut[lo] : cut[hi]] = s.hashes(at, end) if plain else s.hashes(edge[at], edge[end])
    return out, cut


def band_keys(shingle: np.ndarray, cut: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band values per line."""
    short = (shingle >> U64(32)).astype(np.uint32)
    out = np.zeros((len(cut) - 1, bands), U64)
    for band in range(bands):
        key = np.full(len(cut) - 1, band + 1, U64)
        for k in range(band * rows, band * rows + rows):
            key = tb.mix(key * U64(0xD1342543DE82EF95) + np.minimum.reduceat(short * _MULTIPLY[k] + _ADD[k], cut[:-1]).astype(U64))
        out[:, band] = key
    return out


def _slices(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for s in tb.slices(tb.as_bytes(b.column(1))):
            yield b.column(0).slice(s.lo, s.n).to_numpy(zero_copy_only=False).astype(np.int64), s


def _occurrences(docs: DataFrame) -> DataFrame:
    """line, doc_id: the distinct lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _slices(batches):
            _, _, doc, line = find_lines(s)
            order = np.lexsort((doc, line))
            line, doc = line[order], doc[order]
            fresh = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])[: len(line)]
            yield pa.RecordBatch.from_pydict({"line": pa.array(line[fresh].view(np.int64)), "doc_id": pa.array(ids[doc[fresh]])})

    return packed.arrow_map(docs.select("doc_id", "text"), run, "line long, doc_id long").distinct()


def _bands(docs: DataFrame, n: int) -> DataFrame:
    """root, class, doc_id: groups of lines that agree in a band, with a document that holds each."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _slices(batches):
            first, last, doc, line = find_lines(s)
            if not len(line):
                continue
            at = np.unique(line, return_index=True)[1]
            first, last, doc, line = first[at], last[at], doc[at], line[at]
            keys = band_keys(*line_shingles(s, first, last, WIDTH), BANDS, ROWS).ravel()
            order = np.argsort(keys)
            keys, owner = keys[order], (order // BANDS)
            edge = packed.bounds(keys, n)
            full = np.flatnonzero(np.diff(edge)).tolist()
            cols = [
                pa.array(full, pa.int32()),
                pa.array([packed.squeeze(keys[edge[k] : edge[k + 1]]) for k in full], pa.binary()),
                pa.array([line[owner[edge[k] : edge[k + 1]]].astype("<u8").tobytes() for k in full], pa.binary()),
                pa.array([packed.planes(ids[doc[owner[edge[k] : edge[k + 1]]]], "<i8") for k in full], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "keys", "lines", "docs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(packed.expand(r["keys"]), np.frombuffer(r["lines"], "<u8"), packed.unplanes(r["docs"], "<i8")) for r in packed.rows_of(batches)]
        if not rows:
            return
        key, line, doc = (np.concatenate([r[k] for r in rows]) for k in range(3))
        del rows
        order = np.lexsort((doc, line, key))
        key, line, doc = key[order], line[order], doc[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
        key, line, doc = key[fresh], line[fresh], doc[fresh]
        same = key[1:] == key[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, line, doc = key[keep], line[keep], doc[keep]
        at = packed.starts(key)
        count = np.diff(np.append(at, len(key)))
        root = np.repeat(tb.mix(np.add.reduceat(tb.mix(line), at) ^ count.astype(U64)) if len(at) else key, count)  # of the lines alone
        for lo in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000].view(np.int64)) for x in (root, line, doc)], names=["root", "class", "doc_id"])

    blobs = packed.arrow_map(docs.select("doc_id", "text"), spread, "part int, keys binary, lines binary, docs binary")
    return packed.arrow_map(packed.deal(blobs, n), meet, "root long, class long, doc_id long").groupBy("root", "class").agg(F.min("doc_id").alias("doc_id"))


def _places(found: DataFrame) -> int:
    """How many rows block_pairs makes of found: each line of a group stands once for each block of its group."""
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(BLOCK_LINES)))).first()[0] or 0


def _texts(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """The wanted lines (class, root, blocks, mine, other, doc_id) with their text.  few: their places can be broadcast."""
    place = F.struct("class", "root", "mine", "other")
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(place).alias("wanted"))  # at most a document's lines, in their blocks
    rows = docs.select("doc_id", "text").join(F.broadcast(per_doc) if few else per_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(tb.as_bytes(b.column(1))):
                first, last, doc, line = find_lines(s)
                raw, out = s.buf.tobytes(), []
                at = {(d, x): (f, e) for d, x, f, e in zip(doc.tolist(), line.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)}
                for d, places in enumerate(b.column(2).slice(s.lo, s.n).to_pylist()):
                    out += [(p["class"], p["root"], p["mine"], p["other"], raw[slice(*at[d, p["class"]])]) for p in places if (d, p["class"]) in at]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["class", "root", "mine", "other", "text"])

    return packed.arrow_map(rows, run, "class long, root long, mine int, other int, text binary")


def verified(groups: list[list[tuple[int, bytes]]], percent: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """The components of the lines (class, text) of each group under links of at least percent% Jaccard similarity, as
    links of each line with the smallest class of its component.

    The sets of all lines are made at once.  Overlaps of two lines are counted by what stands twice, those of up to
    DENSE_LINES by a product of the group's incidence matrix with itself, those of larger groups in prefix trees.
    """
    groups = [sorted(g) for g in groups]
    cls, raw = zip(*(r for g in groups for r in g), strict=True)
    n_of = np.array([len(g) for g in groups])
    begin = np.cumsum(n_of) - n_of
    s = tb.Slice(list(raw), 0)
    shingle, cut = line_shingles(s, s.start, s.end, width)
    # a key's high bits tell shingles of different groups apart, its low bits are the line
    line = np.repeat(np.arange(len(raw)), np.diff(cut))
    low = U64(max(1, (len(raw) - 1).bit_length()))
    seed = tb.mix(np.repeat(np.arange(len(groups), dtype=U64), n_of) + U64(1))
    key = np.sort(tb.mix(shingle ^ seed[line]) >> low << low | line.astype(U64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    line = (key & ((U64(1) << low) - U64(1))).astype(np.int64)
    size = np.bincount(line, minlength=len(raw))
    key >>= low
    same = key[1:] == key[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    column = np.cumsum(np.concatenate([[True], ~same]))[shared]  # a number for each shingle that lines of a group share
    line = line[shared]
    group = np.repeat(np.arange(len(groups)), n_of)[line]
    both = np.bincount(group, minlength=len(groups)) // 2  # of groups of two
    a, b = begin, np.minimum(begin + 1, len(raw) - 1)
    linked = (n_of == 2) & (100 * both >= percent * (size[a] + size[b] - both))
    out = [(cls[begin[g] + 1], cls[begin[g]]) for g in np.flatnonzero(linked).tolist()]
    order = np.argsort(group.astype(np.uint16), kind="stable")  # at most some thousand groups
    ends = np.searchsorted(group[order], np.arange(len(groups) + 1))
    for g in np.flatnonzero(n_of > 2).tolist():
        at = order[ends[g] : ends[g + 1]]
        n, own, sizes = int(n_of[g]), line[at] - begin[g], size[begin[g] : begin[g] + n_of[g]]
        mine = cls[begin[g] : begin[g] + n]
        if n > DENSE_LINES:
            by = np.argsort(own, kind="stable")
            sets = np.split(column[at][by], np.searchsorted(own[by], np.arange(1, n)))
            out += jaccard.links_in_group(list(mine), sizes.tolist(), sets, None, percent)
            continue
        overlap = np.zeros((n, n), np.float32)
        place = np.cumsum(np.concatenate([[0], np.diff(column[at]) != 0]))[: len(at)]
        for lo in range(0, int(place.max(initial=-1)) + 1, DENSE_COLUMNS):
            some = slice(*np.searchsorted(place, (lo, lo + DENSE_COLUMNS)))
            has = np.zeros((n, min(DENSE_COLUMNS, int(place[-1]) + 1 - lo)), np.float32)
            has[own[some], place[some] - lo] = 1
            overlap += has @ has.T
        near = 100 * overlap >= percent * (sizes[:, None] + sizes[None] - overlap)
        near[np.diag_indices(n)] = True
        label, before = np.where(near, np.arange(n), n).min(1), None
        while before is None or (label != before).any():
            before, label = label, np.where(near, label, n).min(1)
        out += [(mine[k], mine[x]) for k, x in enumerate(label.tolist()) if k != x]
    return out


def line_components(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """vertex and root: lines that are linked with other lines, by their hashes."""
    n = packed.n_parts(spark)
    graph.checkpoint_dir(spark)
    docs = docs.where("doc_id is not null")
    found = _bands(docs, n).checkpoint()
    wanted = jaccard.block_pairs(found, F.lit(1), BLOCK_LINES)
    texts = _texts(docs, wanted, _places(found) <= BROADCAST_LINES)
    return graph.components(spark, jaccard.links(texts, n, ("class", "text"), lambda groups: verified(groups, percent)))


def dedup_lines(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with text without the lines that go, and n_lines and n_removed (a column of that name is replaced)."""
    roots = line_components(spark, docs, percent)
    found = _occurrences(docs.where("doc_id is not null")).checkpoint()
    # one row a line, however many documents have it, takes part in the join by root
    each = found.groupBy("line").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("n"))
    each = each.join(roots.withColumnRenamed("vertex", "line"), "line", "left").where("root is not null or n > 1").checkpoint()
    low = each.where("root is not null").groupBy("root").agg(F.min("own").alias("least")).checkpoint()
    each = each.join(low, "root", "left").select("line", F.coalesce("root", "line").alias("root"), F.coalesce("least", "own").alias("least")).checkpoint()
    mark = F.struct("line", "root", (F.col("doc_id") == F.col("least")).alias("here"))
    own = packed.fresh("marks", docs.columns)
    marks = found.join(each, "line").groupBy("doc_id").agg(F.collect_list(mark).alias(own))
    kept = [f for f in docs.schema if f.name not in ("n_lines", "n_removed")]
    rows = docs.select(*[f.name for f in kept]).join(marks.hint("shuffle_hash"), "doc_id", "left").select(*[f.name for f in kept], own)
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in tb.slices(tb.as_bytes(whole.column(at))):
                b = whole.slice(s.lo, s.n)
                first, last, doc, line = find_lines(s)
                marks, texts = b.column(b.num_columns - 1).to_pylist(), b.column(at).to_pylist()
                n_lines = np.bincount(doc, minlength=s.n)
                twice = np.concatenate([[0], np.cumsum(n_lines)])
                removed = np.zeros(s.n, np.int64)
                breaks = np.flatnonzero(s.buf == 10)
                number = np.searchsorted(breaks, first) - np.searchsorted(breaks, s.start[doc])
                signed = line.view(np.int64).tolist()
                for d in range(s.n):
                    own = range(twice[d], twice[d + 1])
                    known = {m["line"]: (m["root"], m["here"]) for m in marks[d] or ()}
                    seen, gone = set(), set()
                    for i in own:
                        root, here = known.get(signed[i], (signed[i], True))  # a line with no mark is of no other document
                        if not here or root in seen:
                            gone.add(int(number[i]))
                        seen.add(root)
                    if gone:
                        removed[d] = len(gone)
                        texts[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)
                cols = [b.column(k) if k != at else pa.array(texts, b.schema.field(at).type) for k in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines.astype(np.int64)), pa.array(removed)], names=[*(f.name for f in kept), "n_lines", "n_removed"])

    schema = docs.select(*[f.name for f in kept]).schema.add("n_lines", "long").add("n_removed", "long")
    return packed.arrow_map(rows, run, schema)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
