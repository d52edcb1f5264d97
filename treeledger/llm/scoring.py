"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model, interpolated with add-one unigrams.  Its counts live in a Bloom filter: an n-gram with count
c is stored as the elements (n-gram, 1) ... (n-gram, q), where q = 1 + floor(steps * log2 c), and a count is read by
probing for 1, 2, ... until a probe fails or the largest level stored is reached.  Bigrams have one step a doubling, words
four.  A count that is multiplied is read as the smallest of its level and one that is divided by as the largest, so the
probabilities of all words behind a word add up to 1 at most: what quantising takes away is left to words that the model
doesn't know.  All words and, by default, all bigrams are stored.  The filter has ``bits`` bits per element, so it follows
the corpus.  It is made of one segment per range of hash values, each built where the exact counts of that range are.

Texts are read once, in slices.  A slice sends each distinct n-gram with its count to the n-gram's range, so a frequent
word is one entry a slice however many documents hold it, and gets back the exact counts of its words, which the base score
is made of.  Its squeezed texts, smaller than their tokens, wait at a home part.  The filter is broadcast where the size of the
texts proves that it can't exceed ``max_filter_mb`` (``filter_bound``); beyond, the n-grams of a slice are probed where the
segments are built, and their levels go home with the counts.  Both ways give the same scores.

Words are known by 64-bit hashes.  The end token, which every text has, is counted apart: its count is the number of
training texts.  Defined results: null and empty texts have the end token only; repeated rows are scored alike; a null
doc_id counts as the empty text for the split; without training tokens every count is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, packed
from . import textbytes as tb

U64 = np.uint64
END = U64(0x6C62272E07BB0142)
SLICE = 4 << 20
HASHES = 4
#: Levels a doubling of counts; bits of a bigram's hash that are kept, the others are 0 and needn't be sent.
WORD_STEPS, PAIR_STEPS = 4, 1
PAIR_BITS = U64(0xFFFFFFFFFFFF0000)
FOLDS, HELD_OUT = 7, 2
#: Of bigrams.
WEIGHT = 0.5


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(s: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document followed by END, and their documents."""
    lo, hi, doc = s.words()
    owner = np.empty(len(lo) + s.n, np.int64)
    out = np.full(len(owner), END, U64)
    ends = np.cumsum(np.bincount(doc, minlength=s.n) + 1) - 1
    at = np.ones(len(owner), bool)
    at[ends] = False
    out[at] = s.hashes(lo, hi)
    owner[at], owner[ends] = doc, np.arange(s.n)
    return out, owner


def bigrams(token: np.ndarray) -> np.ndarray:
    """Each token with the one before it; a text begins behind an END."""
    before = np.concatenate([[END], token[:-1]]).astype(U64)
    return tb.mix(before * U64(0xD1342543DE82EF95) + token) & PAIR_BITS


def text_key(s: tb.Slice, ids: list[int | None]) -> np.ndarray:
    """Known rows apart by doc_id and text."""
    own = np.array([0 if x is None else x & 0xFFFFFFFFFFFFFFFF for x in ids], U64)
    return tb.mix(tb.mix(own) ^ s.hashes(s.start, s.end))


#: Rows that are exchanged: n-grams of a slice, what their range says of them, texts at home, a range's own figures.
ASKED = "part int, slice long, words binary, times binary, pairs binary, pair_times binary, text binary, sizes binary, ids array<long>"
MET = "part int, slice long, of int, counts binary, levels binary, pair_levels binary, text binary, sizes binary, ids array<long>, segment binary, most int, learned long, distinct long"


def _batch(kind: str, **row) -> pa.RecordBatch:
    """One row; columns that aren't given are null."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, types[of]) for name, of in (x.split() for x in kind.split(", "))])
    return pa.RecordBatch.from_pylist([row], schema)


def _counts(docs: DataFrame, n: int) -> DataFrame:
    """Per slice: a row for each range that has n-grams of it, with their training counts, and one for its home part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids = b.column(0).to_pylist()
            for s in tb.slices(tb.as_bytes(b.column(1)), True, SLICE):
                own = ids[s.lo : s.lo + s.n]
                learn = np.array([not held_out(x) for x in own])
                me = int.from_bytes(hashlib.blake2b(text_key(s, own).tobytes(), digest_size=8).digest(), "little", signed=True)
                token, owner = tokens(s)
                learnt, word = learn[owner], token != END
                words, place = np.unique(token[word], return_inverse=True)
                times = np.bincount(place, learnt[word], len(words))
                pairs, pair_place = np.unique(bigrams(token), return_inverse=True)
                pair_times = np.bincount(pair_place, learnt, len(pairs))
                edge, pair_edge = packed.bounds(words, n), packed.bounds(pairs, n)
                for k in np.flatnonzero(np.diff(edge) + np.diff(pair_edge)).tolist():
                    w, p = slice(edge[k], edge[k + 1]), slice(pair_edge[k], pair_edge[k + 1])
                    yield _batch(ASKED, part=k, slice=me, words=packed.squeeze(words[w]), times=packed.planes(times[w], "<u4"), pairs=packed.squeeze(pairs[p]), pair_times=packed.planes(pair_times[p], "<u4"))
                yield _batch(ASKED, part=me % n, slice=me, text=small(s.buf.tobytes()), sizes=small(packed.planes(s.end - s.start, "<u8")), ids=own)

    return packed.arrow_map(docs.select("doc_id", "text"), run, ASKED)


def quantised(counts: np.ndarray, steps: int) -> np.ndarray:
    """The level of each count (at least 1)."""
    level = np.frexp(counts.astype(float))[1].astype(np.int64)  # 1 + floor(log2)
    if steps > 1:
        level = np.floor(steps * np.log2(counts) + 1e-9).astype(np.int64) + 1
    return level


def range_of(level: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest count of each level; 0 for level 0."""
    low, high = np.ceil(2.0 ** ((level - 1) / steps) - 1e-9), np.ceil(2.0 ** (level / steps) - 1e-9) - 1
    return np.where(level > 0, low, 0.0), np.where(level > 0, np.maximum(low, high), 0.0)


class Filter:
    """A log-frequency Bloom filter in segments: edges are the segments' first bits, and the end; most the largest level,
    of all or of each segment."""

    def __init__(self, data: bytes | bytearray, edges: np.ndarray, most: int | np.ndarray):
        self.data, self.edges, self.most = np.frombuffer(data, np.uint8), edges, np.broadcast_to(most, len(edges) - 1)

    @staticmethod
    def places(keys: np.ndarray, level: int, which: int, bits: np.ndarray | np.uint64) -> np.ndarray:
        return tb.mix(keys + U64((level * HASHES + which + 1) * 0x9E3779B97F4A7C15 % 2**64)) % bits

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
        size = max(64, -(-int(levels.sum()) * bits // 8) * 8)
        flags = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            stored = keys[levels >= level]
            for which in range(HASHES):
                flags[cls.places(stored, level, which, U64(size))] = True
        return np.packbits(flags).tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels each key has, 0 for keys that aren't there."""
        n = len(self.edges) - 1
        part = ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
        first, bits, most = self.edges[part], (self.edges[part + 1] - self.edges[part]).astype(U64), self.most[part]
        level, step = np.zeros(len(keys), np.int64), 0
        live = np.flatnonzero(most > 0)
        while len(live):  # a full filter ends too
            step += 1
            for which in range(HASHES):
                place = self.places(keys[live], step, which, bits[live]).astype(np.int64) + first[live]
                live = live[self.data[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1]
                if not len(live):
                    break
            level[live] = step
            live = live[most[live] > step]
        return level


def filter_bound(tokens: int, bits: int, n: int) -> int:
    """Bytes that a filter of so many training tokens can't exceed.  An n-gram seen c times has at most c elements as a
    bigram (1 + log2 c) and 2.5 c as a word (1 + 4 log2 c), and a segment is rounded up by 9 bytes at most."""
    return math.ceil(tokens * 3.5 * bits / 8) + 9 * n


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums of times, and the place of each given key among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(times), len(distinct)).astype(np.int64), at


def _meet(blobs: DataFrame, n: int, bits: int, min_bigram: int, probe: bool) -> DataFrame:
    """Per range of hashes: a row with its figures and, unless probe is set, its filter segment, and a row for each slice
    with the counts of its words and, with probe, the levels of its n-grams.  Rows of home parts pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, words, times, pairs, pair_times = None, [], [], [], [], []
        for r in packed.rows_of(batches):
            if r["ids"] is not None:
                yield _batch(MET, **{x: r[x] for x in ("part", "slice", "text", "sizes", "ids")})
                continue
            here = r["part"]
            asked.append(r["slice"])
            words.append(packed.expand(r["words"]))
            times.append(packed.unplanes(r["times"], "<u4"))
            pairs.append(packed.expand(r["pairs"]))
            pair_times.append(packed.unplanes(r["pair_times"], "<u4"))
        if here is None:
            return
        cut, pair_cut = (np.concatenate([[0], np.cumsum([len(y) for y in x])]).tolist() for x in (words, pairs))
        word, count, at = _summed(words, times)
        pair, pair_count, pair_at = _summed(pairs, pair_times)
        del words, times, pairs, pair_times
        stored, pair_stored = count > 0, pair_count >= max(1, min_bigram)
        levels = np.concatenate([quantised(count[stored], WORD_STEPS), quantised(pair_count[pair_stored], PAIR_STEPS)])
        segment = Filter.segment(np.concatenate([word[stored], pair[pair_stored]]), levels, bits)
        most = int(levels.max(initial=0))
        yield _batch(MET, part=here, segment=None if probe else segment, most=most, learned=int(count.sum()), distinct=int(stored.sum()))
        if probe:
            f = Filter(segment, np.array([0, 8 * len(segment)], np.int64), most)
            level, pair_level = (f.levels(x).astype(np.uint8) for x in (word, pair))
        small = zstandard.ZstdCompressor(level=1).compress
        for k, me in enumerate(asked):
            w, p = at[cut[k] : cut[k + 1]], pair_at[pair_cut[k] : pair_cut[k + 1]]
            found = {"levels": small(level[w].tobytes()), "pair_levels": small(pair_level[p].tobytes())} if probe else {}
            yield _batch(MET, part=me % n, slice=me, of=here, counts=small(packed.planes(count[w], "<u8")), **found)

    return packed.arrow_map(packed.deal(blobs, n), run, MET)


@dataclass(frozen=True)
class Model:
    """What the counts of n-grams are turned into probabilities with: the bigrams' weight, the training texts, and all
    training tokens and distinct tokens plus one."""

    weight: float
    ends: int
    total: int

    def log_p(self, kinds: np.ndarray, word_levels: np.ndarray, at: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 probability of each token.  kinds, word_levels: distinct tokens and their levels; at: the tokens' places
        there; pair_levels: of each token with the one before it."""
        low, high = range_of(word_levels, WORD_STEPS)
        low, high = (np.where(kinds == END, float(self.ends), x)[at] for x in (low, high))
        before = np.concatenate([[float(self.ends)], high[:-1]])
        one = (low + 1) / self.total
        both = np.minimum(range_of(pair_levels, PAIR_STEPS)[0], before) / np.maximum(before, 1)
        return np.log10(np.where(before > 0, self.weight * both + (1 - self.weight) * one, one))


def _broadcast(spark: SparkSession, met: DataFrame, figures: list, n: int):
    """The filter of the segments in met, as a broadcast of its bytes, edges and largest levels."""
    size, most = np.full(n, 8, np.int64), np.zeros(n, np.int64)
    for r in figures:
        size[r["part"]], most[r["part"]] = r["size"], r["most"]
    edges = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int64)
    data = bytearray(int(size.sum()))
    for r in met.where("segment is not null").select("part", "segment").toLocalIterator():  # one segment at a time
        at = int(edges[r["part"]]) // 8
        data[at : at + len(r["segment"])] = r["segment"]
    return spark.sparkContext.broadcast((data, edges, most))


def _scored(met: DataFrame, n: int, model: Model, shared) -> DataFrame:
    """Scores of each slice's texts, where they and all answers meet.  shared: the filter, None if levels are answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor().decompress
        f = Filter(*shared.value) if shared else None
        homes, answers = [], {}
        for r in packed.rows_of(batches):
            if r["ids"] is not None:
                homes.append(r)
            else:
                answers.setdefault(r["slice"], {})[r["of"]] = r["counts"], r["levels"], r["pair_levels"]
        for r in homes:
            end = np.cumsum(packed.unplanes(large(r["sizes"]), "<u8").astype(np.int64) + 1) - 1
            raw = large(r["text"])
            token, owner = tokens(tb.Slice([raw[x:y] for x, y in zip([0, *(end[:-1] + 1).tolist()], end.tolist())], 0))
            word, sizes = token != END, np.bincount(owner, minlength=len(end)).astype(np.int64)
            words, place = np.unique(token[word], return_inverse=True)
            kinds, at = np.append(words, END), np.full(len(token), len(words))
            at[word] = place
            pairs, pair_at = np.unique(bigrams(token), return_inverse=True)
            mine = [x for _, x in sorted(answers[r["slice"]].items())]  # ranges of hashes, in order
            count = np.concatenate([packed.unplanes(large(x[0]), "<u8") for x in mine]).astype(np.int64)
            if f:
                level, pair_level = f.levels(kinds), f.levels(pairs)
            else:
                level, pair_level = (np.frombuffer(b"".join(large(x[k]) for x in mine), np.uint8).astype(np.int64) for k in (1, 2))
                level = np.append(level, 0)
            if len(count) != len(words) or len(level) != len(kinds) or len(pair_level) != len(pairs):
                raise ValueError("answers of ranges of hashes are missing")
            c = np.append(count, model.ends)[at]
            each = lambda x: np.bincount(owner, x, minlength=len(sizes))
            base = each(np.log10(c + 1.0)) - sizes * math.log10(model.total)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array([held_out(x) for x in r["ids"]]), "n_tokens": pa.array(sizes), "n_known": pa.array(each(c > 0).astype(np.int64)), "base_score": pa.array(base), "score": pa.array(each(model.log_p(kinds, level, at, pair_level[pair_at])))})

    exchanged = met.where("slice is not null").select("part", "slice", "of", "counts", "levels", "pair_levels", "text", "sizes", "ids")
    return packed.arrow_map(packed.deal(exchanged, n), run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(spark: SparkSession, docs: DataFrame, weight: float = WEIGHT, bits: int = 14, max_filter_mb: int = 128, min_bigram: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    score: sum of log10(weight * c(previous, w) / c(previous) + (1 - weight) * (c(w) + 1) / (N + V + 1)), counts from the
    filter; a previous token without count leaves the words' part alone.
    """
    n = packed.n_parts(spark)
    graph.checkpoint_dir(spark)
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
    # words are a byte at least and stand apart, so a text has half as many at most, and one end
    most_words = F.expr("(coalesce(octet_length(text), 0) + 1) div 2")
    seen = docs.agg(F.count(F.when(learned, 1)).alias("ends"), F.coalesce(F.sum(F.when(learned, most_words)), F.lit(0)).alias("words")).first()
    ends = seen["ends"]
    probe = filter_bound(seen["words"] + ends, bits, n) > max_filter_mb << 20
    met = _meet(_counts(docs, n), n, bits, min_bigram, probe).checkpoint()
    figures = met.where("most is not null").select("part", F.length("segment").alias("size"), "most", "learned", "distinct").collect()  # n rows at most
    train_tokens, distinct = sum(r["learned"] for r in figures) + ends, sum(r["distinct"] for r in figures) + (ends > 0)
    shared = None if probe else _broadcast(spark, met, figures, n)
    rows = _scored(met, n, Model(weight, ends, train_tokens + distinct + 1), shared)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
