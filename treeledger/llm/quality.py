"""Quality rules: line sequence labelling with a linear-chain conditional random field.

Each line of a document with at least one word is an element of a sequence with two states, content (0) and boilerplate
(1).  Viterbi decoding picks the best state sequence; a document stays when the share of its words that stand in content
lines reaches ``min_share`` and none of the plain rules rejects it.  The field is trained here, on a bounded sample of
labelled documents (``sample_docs``, and a run of at most ``sample_lines`` lines at a hashed place of each; these two
bounds are the only ones: scoring always sees whole texts).

Defined results: a null or empty text has no words, fails the plain rules and isn't kept; repeated rows are judged one by
one; an empty table gives an empty result; other columns pass through untouched.  Without usable labels (none, or of one
class only) the field keeps ``PRIOR``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from . import textbytes as tb

FEATURES = ("bias", "symbols", "marks", "capitals", "digits", "repeats", "copy", "short", "length", "vowel_free")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?;:=_~^\\/{}[]@+")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Field:
    """Weights of state 1 against state 0 for each feature, and the transition scores [from][to]."""

    weights: tuple[float, ...]
    transitions: tuple[tuple[float, float], tuple[float, float]]


PRIOR = Field((-2.0, 30.0, 20.0, 8.0, 4.0, 4.0, 1.0, 0.0, 0.0, 0.0), ((1.0, -1.0), (-1.0, 1.0)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def describe(s: tb.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document the five counts of STATS; per line with a word its features, document and number of words."""
    lo, hi, doc = s.words()
    word = s.hashes(lo, hi)
    seed = tb.mix(np.arange(s.n, dtype=np.uint64) + np.uint64(1))
    gram, at = tb.windows(word, doc, 5)
    hot = repeated(gram ^ seed[doc[at]])
    edge = np.zeros(len(lo) + 6, np.int32)
    np.add.at(edge, at[hot], 1)
    np.add.at(edge, at[hot] + 5, -1)
    again = np.cumsum(edge)[: len(lo)] > 0
    breaks = np.flatnonzero(s.buf == 10)
    first = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    span = np.searchsorted(lo, np.stack([first, breaks]))  # words from, to
    full = span[1] > span[0]
    first, last, n_words = first[full], breaks[full], (span[1] - span[0])[full].astype(float)
    owner = s.document(first)
    line = s.hashes(first, last) ^ seed[owner]
    copy, alone = later(line), ~repeated(line)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[last] - total[first]).astype(float)

    inside = tb.WORD[s.buf]
    chars = inside & LEAD[s.buf]
    n_chars = np.maximum(per_line(chars), 1)
    twice = np.concatenate([[0], np.cumsum(again)])
    total = span[:, full]
    x = np.stack(
        [
            np.ones(len(first)),
            np.minimum(per_line(SYMBOL[s.buf]) / n_chars, 0.5),
            np.minimum(per_line(MARK[s.buf]) / n_chars, 0.5),
            per_line(CAPITAL[s.buf]) / n_chars,
            per_line(DIGIT[s.buf]) / n_chars,
            alone * (twice[total[1]] - twice[total[0]]) / n_words,  # repeats inside a line; a line that returns whole is a copy
            copy.astype(float),
            (n_words < 4).astype(float),
            np.log1p(n_words) / 5,
            (n_chars / n_words > 15).astype(float),
        ],
        axis=1,
    )
    per_doc = lambda rows: np.bincount(rows, minlength=s.n)
    stats = np.stack([per_doc(doc), s.count(chars), s.count(SYMBOL[s.buf]), per_doc(owner[copy]), per_doc(doc[again])], axis=1)
    return stats, x, owner, n_words


def viterbi(score: np.ndarray, owner: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best state of each line.  score: of state 1 over state 0; lines of one owner stand together, in order."""
    n = len(score)
    if not n:
        return np.zeros(0, np.int8)
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(heads, n))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    back = np.zeros((n, 2), np.int8)
    best = np.stack([np.zeros(len(heads)), score[heads]], axis=1)
    for t in range(1, sizes[0]):
        live = np.searchsorted(-sizes, -t, side="left")  # sequences longer than t stand first
        step = best[:live, :, None] + transitions[None]
        back[heads[:live] + t] = step.argmax(1)
        best[:live] = step.max(1)
        best[:live, 1] += score[heads[:live] + t]
    state = np.zeros(n, np.int8)
    now = best.argmax(1).astype(np.int8)
    for t in range(sizes[0] - 1, -1, -1):
        live = np.searchsorted(-sizes, -t, side="left")
        at = heads[:live] + t
        state[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return state


def judge(s: tb.Slice, field: Field, min_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, content share and kept of each document of a slice."""
    stats, x, owner, n_words = describe(s)
    state = viterbi(x @ np.array(field.weights), owner, np.array(field.transitions))
    content = np.bincount(owner, weights=n_words * (state == 0), minlength=s.n)
    share = content / np.maximum(stats[:, 0], 1)
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    return stats, failed, share, ~failed & (share >= min_share)


def fit(seqs: list[np.ndarray], labels: np.ndarray, rounds: int = 80, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; a document's label stands for each of its lines, so the transitions get the
    stronger penalty: labels that never change within a document say little about where content begins."""
    if not len(seqs) or labels.min() == labels.max():
        return PRIOR
    n, longest, k = len(seqs), max(len(x) for x in seqs), len(FEATURES)
    x, size = np.zeros((n, longest, k)), np.array([len(q) for q in seqs])
    for i, q in enumerate(seqs):
        x[i, : len(q)] = q
    live = np.arange(longest)[None] < size[:, None]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, tr = np.zeros(k), np.zeros((2, 2))
    moment = [np.zeros(k), np.zeros(k), np.zeros((2, 2)), np.zeros((2, 2))]
    truth = np.zeros((2, 2))
    for y in (0, 1):
        truth[y, y] = (weight * (labels == y) * (size - 1)).sum()
    for r in range(1, rounds + 1):
        s1 = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        alpha = np.zeros((n, longest, 2))
        alpha[:, 0] = s1[:, 0]
        for t in range(1, longest):
            step = alpha[:, t - 1, :, None] + tr[None]
            m = step.max(1)
            alpha[:, t] = np.where(live[:, t, None], m + np.log(np.exp(step - m[:, None]).sum(1)) + s1[:, t], alpha[:, t - 1])
        beta, pair = np.zeros((n, 2)), np.zeros((2, 2))
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        marginal = np.zeros((n, longest))
        for t in range(longest - 1, -1, -1):
            marginal[:, t] = np.exp(alpha[:, t, 1] + beta[:, 1] - z)
            if t:
                joint = np.exp(alpha[:, t - 1, :, None] + tr[None] + (s1[:, t] + beta)[:, None] - z[:, None, None])
                pair += (joint * (weight * live[:, t])[:, None, None]).sum(0)
                step = tr[None] + (s1[:, t] + beta)[:, None]
                m = step.max(2)
                beta = np.where(live[:, t, None], m + np.log(np.exp(step - m[:, :, None]).sum(2)), beta)
        miss = (labels[:, None] - marginal) * live * weight[:, None]
        for i, (value, grad) in enumerate(((w, np.einsum("nt,ntk->k", miss, x) - ridge * w), (tr, truth - pair - 0.05 * tr))):
            moment[2 * i] = 0.9 * moment[2 * i] + 0.1 * grad
            moment[2 * i + 1] = 0.99 * moment[2 * i + 1] + 0.01 * grad**2
            value += rate * (moment[2 * i] / (1 - 0.9**r)) / (np.sqrt(moment[2 * i + 1] / (1 - 0.99**r)) + 1e-9)
    return Field(tuple(map(float, w)), tuple(map(tuple, tr.tolist())))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 800, sample_lines: int = 32) -> Field:
    """Fits the field on at most sample_docs labelled documents (smallest hash of doc_id first) and sample_lines of each."""
    picked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "_quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, quality = tb.as_bytes(b.column(0)), b.column(1).to_pylist()
            for s in tb.slices(texts):
                _, x, owner, _ = describe(s)
                place = s.hashes(s.start, s.end)
                for i in range(s.n):
                    q = x[owner == i]
                    first = int(place[i] % np.uint64(max(1, len(q) - sample_lines + 1)))  # a run of lines anywhere in the text
                    q = q[first : first + sample_lines]
                    if len(q):
                        yield pa.RecordBatch.from_pydict({"label": pa.array([quality[s.lo + i]], pa.int32()), "x": pa.array([q.astype("<f4").tobytes()], pa.binary())})

    got = packed.arrow_map(rows, features, "label int, x binary")
    got = got.orderBy("label", F.xxhash64("x"), "x").limit(2 * sample_docs).toPandas()  # the same wherever the rows were
    seqs = [np.frombuffer(v, "<f4").astype(float).reshape(-1, len(FEATURES)) for v in got["x"]]
    return fit(seqs, 1 - got["label"].to_numpy(dtype=int))  # quality 0 is boilerplate


def quality_signals(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """Per document: doc_id, the counts of STATS, base_failed, content_share and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for b in batches:
            texts = tb.as_bytes(b.column(1))
            for s in tb.slices(texts):
                stats, failed, share, kept = judge(s, field, min_share)
                cols = {"doc_id": b.column(0).slice(s.lo, s.n)} | {c: pa.array(stats[:, i].astype(np.int64)) for i, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict(cols | {"base_failed": pa.array(failed), "content_share": pa.array(share), "kept": pa.array(kept)})

    return packed.arrow_map(docs.select("doc_id", "text"), run, f"doc_id long, {STATS}, base_failed boolean, content_share double, kept boolean")


def quality_filter(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose text is kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = tb.as_bytes(b.column(at))
            kept = [judge(s, field, min_share)[3] for s in tb.slices(texts)]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return packed.arrow_map(docs, run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_signals(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
