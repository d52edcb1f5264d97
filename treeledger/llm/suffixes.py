"""Suffix-array dedup: removes what repeats a document with a smaller doc_id, byte by byte.

A byte goes when it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id.  The
steps:

1. Each run of ``length``-byte strings with the same least hash among their ``anchor``-byte parts is a segment, known by
   that hash; equal strings lie in segments of one hash.  Hashes that stand in one document only are dropped: no string
   of theirs can repeat another document.
2. The segments left, each distinct one once with the documents it stands in, are dealt by their hash into shards.  A
   shard's suffixes are sorted by external induced sorting with common-prefix values (``induced``), with queues that go to
   disk beyond ``budget`` bytes; runs with a common prefix of ``length`` are the equal strings, and the smallest doc_id
   of a run decides for all its places.
3. The ranges that go are joined to their documents and merged.

Defined results: a null text is empty, and null when it was null; rows with a null doc_id neither lose nor repeat
anything; rows that repeat a doc_id are one document to each other (no smaller doc_id), and each loses what any of them
loses only where its own text has it, for equal texts the same; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced, packed
from . import textbytes as tb

U64 = np.uint64
SHARD_BYTES = 2 << 20
#: Strings of segments that are held against their documents at once.
STRINGS = 1 << 19
ANCHOR = 16


def segments(s: tb.Slice, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string, number of strings and document of each segment of a slice."""
    n, width = len(s.buf), length - anchor + 1
    if n < length:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    at = np.arange(n - anchor + 1)
    low, span = s.hashes(at, at + anchor), 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    valid = np.zeros(len(low) + 1, bool)  # strings that don't leave their document
    edge = np.zeros(len(low) + 1, np.int32)
    whole = s.end - s.start >= length
    np.add.at(edge, s.start[whole], 1)
    np.add.at(edge, s.end[whole] - length + 1, -1)
    valid[:-1] = np.cumsum(edge[:-1]) > 0
    fresh = valid[:-1] & np.concatenate([[True], (low[1:] != low[:-1]) | ~valid[:-2]])
    first = np.flatnonzero(fresh)
    stop = np.flatnonzero(valid[:-1] & (np.append(fresh[1:], True) | ~valid[1:])) + 1
    return tb.mix(low[first]), first, stop - first, s.document(first)  # least hashes crowd near 0: mixed, they spread over all parts


def _slices(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for s in tb.slices(tb.as_bytes(b.column(1))):
            yield b.slice(s.lo, s.n), b.column(0).slice(s.lo, s.n).to_numpy(zero_copy_only=False).astype(np.int64), s


def _named(docs: DataFrame, length: int, anchor: int, n: int) -> DataFrame:
    """Blobs (part, keys, docs): the distinct segment hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, s in _slices(batches):
            key, _, _, doc = segments(s, length, anchor)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            keep = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]
            key, own = key[keep], ids[doc[keep]]
            edge = packed.bounds(key, n)
            full = np.flatnonzero(np.diff(edge)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed.squeeze(key[edge[k] : edge[k + 1]]) for k in full], pa.binary()), pa.array([packed.planes(own[edge[k] : edge[k + 1]], "<i8") for k in full], pa.binary())], names=["part", "keys", "docs"])

    return packed.arrow_map(docs, run, "part int, keys binary, docs binary")


def _by_document(part_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part_of, kind="stable")
    return order, packed.bounds(part_of[order], n)


def _shared(named: DataFrame, n: int) -> DataFrame:
    """doc_id and keys (sorted): the segment hashes that other documents have too."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(packed.expand(r["keys"]), packed.unplanes(r["docs"], "<i8")) for r in packed.rows_of(batches)]
        if not rows:
            return
        key, doc = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        del rows
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        at = packed.starts(key)
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        keep = np.repeat(several, np.diff(np.append(at, len(key))))
        key, doc = key[keep], doc[keep]
        order, edge = _by_document(tb.mix(doc.view(U64)), n)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = np.sort(order[edge[k] : edge[k + 1]])  # keys stay in order
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed.squeeze(key[at])]), pa.array([packed.planes(doc[at], "<i8")])], names=["part", "keys", "docs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(packed.expand(r["keys"]), packed.unplanes(r["docs"], "<i8")) for r in packed.rows_of(batches)]
        if not rows:
            return
        key, doc = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        at = packed.starts(doc)
        end = np.append(at[1:], len(doc))
        for lo in range(0, len(at), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[lo : lo + 1000]]), pa.array([key[a:e].astype("<u8").tobytes() for a, e in zip(at[lo : lo + 1000].tolist(), end[lo : lo + 1000].tolist(), strict=True)])], names=["doc_id", "keys"])

    kind = "part int, keys binary, docs binary"
    return packed.arrow_map(packed.deal(packed.arrow_map(packed.deal(named, n), meet, kind), n), gather, "doc_id long, keys binary")


def _cut(rows: DataFrame, length: int, anchor: int, n: int) -> DataFrame:
    """Blobs of segments whose hashes are shared: distinct texts, and where they stand (the owner's number in docs and
    row_keys, and the byte).  rows: doc_id, text, keys, row_key."""
    names = ("part", "keys", "sizes", "texts", "which", "owners", "begins", "docs", "row_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squash = zstandard.ZstdCompressor(level=1)
        for b, ids, s in _slices(batches):
            key, first, count, doc = segments(s, length, anchor)
            row_key = b.column(3).to_numpy()
            shared = [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
            seed = tb.mix(np.arange(s.n, dtype=U64) + U64(1))
            known = np.concatenate([x ^ seed[d] for d, x in enumerate(shared)]) if shared else np.zeros(0, U64)
            keep = np.isin(key ^ seed[doc], known)
            key, first, count, doc = key[keep], first[keep], count[keep], doc[keep]
            size = count + length - 1
            text = s.hashes(first, first + size)
            order = np.lexsort((text, key))
            key, first, size, doc, text = key[order], first[order], size[order], doc[order], text[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])[: len(key)]
            which, one = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            edge = packed.bounds(key, n)
            raw = s.buf.tobytes()
            rows = []
            for k in np.flatnonzero(np.diff(edge)).tolist():
                a, e = edge[k], edge[k + 1]
                mine = one[(one >= a) & (one < e)]
                here, local = np.unique(doc[a:e], return_inverse=True)
                rows.append((k, packed.squeeze(key[mine]), packed.planes(size[mine], "<u4"), squash.compress(b"".join(raw[f : f + z] for f, z in zip(first[mine].tolist(), size[mine].tolist(), strict=True))), packed.planes(which[a:e] - which[a], "<u4"), packed.planes(local, "<u4"), packed.planes(first[a:e] - s.start[doc[a:e]], "<u4"), packed.planes(ids[here], "<i8"), row_key[here].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return packed.arrow_map(rows, run, ", ".join(f"{x} {'binary' if i else 'int'}" for i, x in enumerate(names)))


def least_documents(texts: list[bytes], least: np.ndarray, length: int, budget: int) -> np.ndarray:
    """The smallest document for each string of the texts, text after text.  least: each text's smallest document."""
    raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: 0 ends a text
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    count = size - length + 1
    cut = np.concatenate([[0], np.cumsum(count)])
    slot = np.full(len(raw), -1, np.int64)  # of the strings, by where they begin
    slot[np.arange(cut[-1]) + np.repeat(begin - cut[:-1], count)] = np.arange(cut[-1])
    out = np.repeat(least, count)
    held: list[np.ndarray] = []
    low = None
    for batch in induced.suffixes(raw, length, budget):  # runs may cross batches
        at = slot[batch["pos"]]
        run = np.cumsum(batch["lcp"] < length)
        whole = at >= 0
        at, run = at[whole], run[whole]
        if not len(at):
            continue
        head = packed.starts(run)
        group = np.minimum.reduceat(out[at], head)
        joins = run[0] == 0 and low is not None
        if joins:
            group[0] = min(int(group[0]), low)
            if group[0] < low:
                for x in held:
                    out[x] = group[0]
        out[at] = np.repeat(group, np.diff(np.append(head, len(at))))
        tail = at[head[-1] :]
        held = [*held, tail] if joins and len(head) == 1 else [tail]
        low = int(group[-1])
    return out


def _ranges(blobs: DataFrame, length: int, n: int, budget: int) -> DataFrame:
    """doc_id, row_keys and row_spans (merged pairs of begin and end): what goes from each row of a document."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, texts, which, doc, row, begin, base = [], [], [], [], [], [], [], 0
        for r in packed.rows_of(batches):
            sizes = packed.unplanes(r["sizes"], "<u4").astype(np.int64)
            key.append(packed.expand(r["keys"]))
            size.append(sizes)
            cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            raw = zstandard.decompress(r["texts"])
            texts += [raw[a:e] for a, e in zip(cut, cut[1:])]
            which.append(packed.unplanes(r["which"], "<u4").astype(np.int64) + base)
            local = packed.unplanes(r["owners"], "<u4")
            doc.append(packed.unplanes(r["docs"], "<i8")[local])
            row.append(np.frombuffer(r["row_keys"], "<i8")[local])
            begin.append(packed.unplanes(r["begins"], "<u4").astype(np.int64))
            base += len(sizes)
        if not texts:
            return
        key, size, which, doc, row, begin = (np.concatenate(x) for x in (key, size, which, doc, row, begin))
        distinct: dict[bytes, int] = {}
        same = np.fromiter((distinct.setdefault(t, len(distinct)) for t in texts), np.int64, len(texts))
        texts = list(distinct)
        del distinct
        keys = np.zeros(len(texts), U64)
        keys[same] = key
        which = same[which]
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        order = np.argsort(keys, kind="stable")
        place = np.argsort(which, kind="stable")
        stands = np.searchsorted(which[place], np.arange(len(texts) + 1))
        heads = packed.starts(keys[order])
        total = np.concatenate([[0], np.cumsum([len(texts[k]) for k in order.tolist()])])
        shards = np.append(heads[packed.starts(total[heads] // SHARD_BYTES)], len(order))  # they end where a hash ends
        for lo, hi in zip(shards[:-1].tolist(), shards[1:].tolist(), strict=True):
            mine = order[lo:hi].tolist()
            found = least_documents([texts[k] for k in mine], least[mine], length, budget)
            yield from gone(mine, found, np.array([len(texts[k]) - length + 1 for k in mine]), place, stands, doc, row, begin)

    def gone(mine, found, count, place, stands, doc, row, begin) -> Iterator[pa.RecordBatch]:
        cut = np.concatenate([[0], np.cumsum(count)])
        low = np.minimum.reduceat(found, cut[:-1])
        out: list[tuple[np.ndarray, ...]] = []
        at = np.concatenate([place[stands[k] : stands[k + 1]] for k in mine])
        owner = np.repeat(np.arange(len(mine)), [stands[k + 1] - stands[k] for k in mine])
        some = doc[at] > low[owner]
        at, owner = at[some], owner[some]
        reach = np.concatenate([[0], np.cumsum(count[owner])])
        steps = np.append(packed.starts(reach[:-1] // STRINGS), len(at)).tolist()
        for step, end in zip(steps[:-1], steps[1:], strict=True):  # so many strings at once, however often a segment stands
            n_of, base = count[owner[step:end]], cut[owner[step:end]]
            offset = np.arange(reach[end] - reach[step]) - np.repeat(reach[step:end] - reach[step], n_of)
            place_of = np.repeat(at[step:end], n_of)
            hit = np.flatnonzero(found[np.repeat(base, n_of) + offset] < doc[place_of])
            if not len(hit):
                continue
            first = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (place_of[hit[1:]] != place_of[hit[:-1]])]))
            last = np.append(first[1:], len(hit)) - 1
            p = place_of[hit[first]]
            out.append((doc[p], row[p], begin[p] + offset[hit[first]], begin[p] + offset[hit[last]] + length))
        if not out:
            return
        d, row, lo, hi = merged(*(np.concatenate([x[k] for x in out]) for k in range(4)))
        order, edge = _by_document(tb.mix(d.view(U64)), n)
        full = np.flatnonzero(np.diff(edge)).tolist()
        pick = [order[edge[k] : edge[k + 1]] for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([packed.planes(x[p], kind) for p in pick], pa.binary()) for x, kind in ((d, "<i8"), (row, "<i8"), (lo, "<u4"), (hi - lo, "<u4")))], names=["part", "docs", "row_keys", "begins", "sizes"])

    def merged(d: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """The ranges of each row of a document, in order, those that touch or overlap as one."""
        order = np.lexsort((lo, row, d))
        d, row, lo, hi = d[order], row[order], lo[order], hi[order]
        other = (d[1:] != d[:-1]) | (row[1:] != row[:-1])
        group = np.cumsum(np.concatenate([[False], other]))
        far = np.maximum.accumulate(hi + group * (1 << 40))  # the furthest end so far, within a row
        fresh = np.concatenate([[True], other | (lo[1:] + group[1:] * (1 << 40) > far[:-1])])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(d)) - 1
        return d[first], row[first], lo[first], far[last] - group[last] * (1 << 40)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(packed.unplanes(r["docs"], "<i8"), packed.unplanes(r["row_keys"], "<i8"), packed.unplanes(r["begins"], "<u4").astype(np.int64), packed.unplanes(r["sizes"], "<u4").astype(np.int64)) for r in packed.rows_of(batches)]
        if not rows:
            return
        d, row, lo, size = (np.concatenate([r[k] for r in rows]) for k in range(4))
        d, row, lo, hi = merged(d, row, lo, lo + size)
        own = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (row[1:] != row[:-1])]))  # where rows begin
        cut = np.append(own, len(d))
        both = np.stack([lo, hi], 1).astype("<i8")
        heads = np.append(packed.starts(d[own]), len(own))  # where documents begin, among rows
        for step in range(0, len(heads) - 1, 1000):
            part = heads[step : step + 1001].tolist()
            keys = [row[own[a:e]].tolist() for a, e in zip(part, part[1:])]
            spans = [[both[cut[k] : cut[k + 1]].tobytes() for k in range(a, e)] for a, e in zip(part, part[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(d[own[part[:-1]]]), pa.array(keys, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.binary()))], names=["doc_id", "row_keys", "row_spans"])

    ranges = packed.arrow_map(packed.deal(blobs, n), sort, "part int, docs binary, row_keys binary, begins binary, sizes binary")
    return packed.arrow_map(packed.deal(ranges, n), gather, "doc_id long, row_keys array<long>, row_spans array<binary>")


def removed_spans(spark: SparkSession, docs: DataFrame, length: int = 50, budget: int = 64 << 20) -> DataFrame:
    """doc_id, text, rest (a struct of docs' other columns) and spans: the byte ranges that go from the row's text, as
    little-endian 64-bit pairs, null where nothing does.

    Places are known by doc_id and a hash of the text, so rows that repeat a doc_id lose what their own text has; the
    texts cross the network once: both joins read one exchange.
    """
    if not 0 < length <= 255:
        raise ValueError("length must be 1 to 255: common prefixes are counted in one byte")
    n, anchor = packed.n_parts(spark), min(ANCHOR, length)
    more = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", F.struct(*(more or [F.lit(0).alias("none")])).alias("rest"))
    known = docs.where("doc_id is not null")
    dealt = known.repartition(n, "doc_id")
    shared = _shared(_named(known.select("doc_id", "text"), length, anchor, n), n)
    rows = dealt.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "keys", F.xxhash64("text").alias("row_key"))
    spans = _ranges(_cut(rows, length, anchor, n), length, n, budget)
    mine = F.when(F.col("row_keys").isNotNull(), F.get("row_spans", F.array_position("row_keys", F.xxhash64("text")).cast("int") - 1))
    found = dealt.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "rest", mine.alias("spans"))
    return found.unionByName(docs.where("doc_id is null").withColumn("spans", F.lit(None).cast("binary")))


def dedup_passages(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """docs, all their columns, with text without the characters whose bytes all lie in ranges that go."""
    names = docs.columns
    rows = removed_spans(spark, docs, length).select(*[c if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in names], F.col("spans").alias(packed.fresh("spans", names)))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, (raw, spans) in enumerate(zip(tb.as_bytes(b.column(at)), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                if spans:
                    texts[i] = without(raw, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist())
            cols = [pa.array(texts, b.schema.field(k).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return packed.arrow_map(rows, run, docs.schema)


def without(raw: bytes, spans: list[list[int]]) -> str:
    """The text without the characters that lie whole in the spans."""
    lead = np.append((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True)
    parts, done = [], 0
    for lo, hi in spans:
        hi = min(hi, len(raw))
        while lo < hi and not lead[lo]:
            lo += 1
        while hi > lo and not lead[hi]:
            hi -= 1
        if lo < hi:
            parts.append(raw[done:lo])
            done = hi
    return b"".join([*parts, raw[done:]]).decode()


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed_spans(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                kept, gone, count, size = [], [], [], []
                for text, spans in zip(tb.as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    pairs = np.frombuffer(spans or b"", "<i8").reshape(-1, 2)
                    pairs = np.minimum(pairs, len(text)).tolist()
                    edges = [0, *(x for p in pairs for x in p), len(text)]
                    kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2])))
                    gone.append(len(text) - len(kept[-1]))
                    count.append(len(pairs))
                    size.append(len(text))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = packed.arrow_map(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
