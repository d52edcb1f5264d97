"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays inside a piece).  Documents longer than the
capacity first give full sequences of their own; what remains is assigned in descending order to the sequence of lowest
cost that still has room.  A piece that fits nowhere whole is cut over the sequences of lowest cost.

Packing runs over groups of about ``group_tokens`` tokens of one input partition, in one pass and without a shuffle; a
group's sequences hold exactly its tokens: all of the full capacity but those of the rest, whose sizes are powers of two
and so need no padding either.  sequence_id is made of the partition and a counter, so a task that runs again after a
lost executor gives the same rows.

Tokens come from a table of distinct words that belongs to a worker process (emptied at ``TABLE_ROWS`` words): the
tokenizer splits at white space and never looks across it.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are packed one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import packed

TABLE_ROWS = 600_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_tables: dict[str, WordTable] = {}
#: What the quick path leaves alone: all but ASCII without rare controls and the Latin-1 letters that have cases.
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: How the tokenizer cuts lower-case text of those characters into words.
_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+")


class WordTable:
    """Little-endian 32-bit ids, as bytes, of words and of chunks between spaces, line ends and tabs.

    Most texts have Latin letters, digits and signs only, whose lower case and parts are plain; of these the distinct
    words are tokenised.  Of other texts the distinct chunks are.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that end a word
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def learn_words(self, new: list[str]) -> None:
        """Tokenises words, each of which the tokenizer takes as one, in a row and cuts their ids apart."""
        if len(self.words) > TABLE_ROWS:
            self.words = {}
        for lo in range(0, len(new), 1000):
            part = new[lo : lo + 1000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(self.last[ids]) + 1) * 4
            self.words.update(zip(part, (data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)), strict=True))

    def learn_chunks(self, new: list[str]) -> None:
        if len(self.chunks) > TABLE_ROWS:
            self.chunks = {"": b""}
        got = self.model.encode_batch_fast(new, add_special_tokens=False)
        self.chunks.update((x, np.array(y.ids, "<u4").tobytes()) for x, y in zip(new, got, strict=True))

    def tokens(self, texts: list[str], end: int) -> list[bytes]:
        plain = [_ODD.search(x) is None for x in texts]
        parts = [_WORD.findall(x.lower()) if p else x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x, p in zip(texts, plain, strict=True)]
        for kind, learn in ((True, self.learn_words), (False, self.learn_chunks)):
            known = self.words if kind else self.chunks
            if len(known) > TABLE_ROWS:
                known = {}  # it is emptied below
            new = set().union(*[x for x, p in zip(parts, plain, strict=True) if p is kind]).difference(known)
            if new:
                learn(list(new))
        tail = end.to_bytes(4, "little")
        return [b"".join([*map((self.words if p else self.chunks).__getitem__, x), tail]) for x, p in zip(parts, plain, strict=True)]


def table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences."""
    out, n_seq = [], 0
    for d in np.flatnonzero(sizes >= capacity).tolist():
        for start in range(0, int(sizes[d]) // capacity * capacity, capacity):
            out.append((d, start, capacity, n_seq, 0))
            n_seq += 1
    rest = sizes % capacity
    total = int(rest.sum())
    tail = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for d in np.argsort(-rest, kind="stable").tolist():
        start, left = int(sizes[d] - rest[d]), int(rest[d])
        while left:
            free = room - used
            fits = free >= left
            at = int(np.where(fits if fits.any() else free > 0, cost, np.inf).argmin())
            n = min(left, int(free[at]))
            out.append((d, start, n, n_seq + at, int(used[at])))
            used[at] += n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out, n_seq + len(room)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, group_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: PIECES; ids are the piece's tokens as little-endian unsigned 32-bit integers."""

    def emit(rows: list[tuple[int | None, bytes]], first: int) -> tuple[list[pa.RecordBatch], int]:
        pieces, n_seq = assign(np.array([len(x) // 4 for _, x in rows], np.int64), capacity, linear, quadratic)
        out = []
        for lo in range(0, len(pieces), 2000):
            part = pieces[lo : lo + 2000]
            cols = [
                pa.array([rows[p[0]][0] for p in part], pa.int64()),
                *(pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)),
                pa.array([len(rows[p[0]][1]) // 4 for p in part], pa.int64()),
                pa.array([first + p[3] for p in part], pa.int64()),
                pa.array([p[4] for p in part], pa.int64()),
                pa.array([rows[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary()),
            ]
            out.append(pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PIECES.split(", ")]))
        return out, first + n_seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size, first = table(path), [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for key, ids in zip(part.column(0).to_pylist(), t.tokens([x or "" for x in part.column(1).to_pylist()], end_id), strict=True):
                    held.append((key, ids))
                    size += len(ids) // 4
                if size >= group_tokens:
                    out, first = emit(held, first)
                    yield from out
                    held, size = [], 0
        if held:
            yield from emit(held, first)[0]

    return packed.arrow_map(docs.select("doc_id", "text"), run, PIECES)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs: end id 2, capacity 4096."""
    import public_tokenizers

    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
