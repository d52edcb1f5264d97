"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one codeword from each of ``stages`` full-dimensional codebooks, those behind
the first times a gain that is stored for the row.  The codebooks start as residual k-means and are then refined together
by least squares; encoding is a beam search over the sum.  A row is stored as its codes, gain and approximation's norm, and a query scores it by ``stages`` look-ups in a
table of its products with the codewords.  The ``shortlist`` best rows of each block of rows are reranked by the exact
cosine of the original vectors, in double precision.

Codebooks are fitted on at most ``sample`` rows (smallest hash of vec_id); every row is indexed.  Queries meet all rows
in cells of a grid: a block of queries and a block of encoded rows, both of bounded size, so nothing is broadcast and no
task sees more than one cell; a cell returns the shortlist of each of its queries only.

Defined results: vectors that are null, empty, zero, of another length than most of the sample, or that hold null or
non-finite components take no part; equal scores go to the smaller vec_id; rows that repeat a vec_id count once, with
their largest score; with fewer candidates than asked for, all are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import packed

ROW_BLOCK = 65_536
#: Queries in a block: the encoded rows are copied once for each, so it is as large as leaves a cell for every part.
MOST_QUERIES, LEAST_QUERIES = 16_384, 256


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and gain of each row of x by beam search.  books: (stages, words, dimensions).

    The first word is taken from the row, the others from what it leaves, brought to length 1; the gain is that length.
    Rows that crowd around a word are told apart as finely as rows that lie far from each other.
    """
    n, (stages, k, d) = len(x), books.shape
    first = (books[0] ** 2).sum(1) - 2 * x @ books[0].T
    keep = min(beam, k)
    word = np.argpartition(first, keep - 1, axis=1)[:, :keep]
    residual = x[:, None, :] - books[0][word]
    gain = np.sqrt((residual**2).sum(2))
    residual = residual / np.maximum(gain, 1e-12)[:, :, None]
    codes, error = word[:, :, None].astype(np.uint8), np.ones((n, keep), np.float32)
    for m in range(1, stages):
        step = ((books[m] ** 2).sum(1) - 2 * residual @ books[m].T + error[:, :, None]).reshape(n, -1)
        wide = (step.reshape(n, -1, k) * (gain**2)[:, :, None]).reshape(n, -1)
        keep = min(beam, wide.shape[1]) if m < stages - 1 else 1
        best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
        error = np.take_along_axis(step, best, 1)
        parent, word = best // k, best % k
        gain = np.take_along_axis(gain, parent, 1)
        residual = np.take_along_axis(residual, parent[:, :, None], 1) - books[m][word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0], gain[:, 0].astype(np.float32)


def approximate(codes: np.ndarray, gain: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[0][codes[:, 0]] + gain[:, None] * sum(books[m][codes[:, m]] for m in range(1, len(books)))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k words for the rows of x and the nearest word of each."""
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book, ((book**2).sum(1) - 2 * x @ book.T).argmin(1)


def fit(x: np.ndarray, stages: int, words: int, beam: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Codebooks for the rows of x (at least one)."""
    rng, k, books = np.random.default_rng(seed), min(words, len(x)), []
    residual = x.copy()
    for m in range(stages):
        book, near = k_means(residual, k, rng)
        residual = residual - book[near]
        if m == 0:
            residual /= np.maximum(np.sqrt((residual**2).sum(1)), 1e-12)[:, None]
        books.append(book)
    out = np.stack(books).astype(np.float32)
    for _ in range(rounds if stages > 1 else 0):  # all codebooks behind the first at once, for the codes that the search finds
        codes, gain = beam_encode(x, out, beam)
        target = (x - out[0][codes[:, 0]]) / np.maximum(gain, 1e-12)[:, None]
        at = codes[:, 1:].astype(np.int64) + np.arange(stages - 1) * k
        gram, right = np.zeros(((stages - 1) * k,) * 2, np.float32), np.zeros(((stages - 1) * k, x.shape[1]), np.float32)
        for a in range(stages - 1):
            np.add.at(right, at[:, a], target)
            for b in range(stages - 1):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        gram[np.diag_indices(len(gram))] += 0.1
        out[1:] = np.linalg.solve(gram, right + 0.1 * out[1:].reshape(len(gram), -1)).reshape(out[1:].shape)
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) and norm of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and size(v) > 0").where(~odd)
    return rows.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))).where("norm > 0")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def train(rows: DataFrame, stages: int, words: int, beam: int, sample: int) -> np.ndarray | None:
    got = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    if not got:
        return None
    d = Counter(map(len, got)).most_common(1)[0][0]
    x = np.array([v for v in got if len(v) == d])
    return fit((x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32), stages, words, beam)


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest scores, equal ones by the smaller id."""
    if len(score) <= n:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - n)[len(score) - n]
    above, level = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
    return np.concatenate([above, level[np.argsort(ids[level], kind="stable")][: n - len(above)]])


def search(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 5, shortlist: int = 250, stages: int = 16, words: int = 256, beam: int = 4, sample: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found rows for each row that queries holds for."""
    rows = _usable(vectors)
    books = train(rows, stages, words, beam, sample)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = books.shape[2]
    rows = rows.where(F.size("v") == d)
    asked = rows.where(queries)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    row_blocks, query_block = max(1, math.ceil(count["n"] / ROW_BLOCK)), MOST_QUERIES
    while query_block > LEAST_QUERIES and row_blocks * math.ceil(count["q"] / query_block) < packed.n_parts(spark):
        query_block //= 2
    query_blocks = max(1, math.ceil(count["q"] / query_block))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, part = b.column(2).to_numpy(), []
            for lo in range(0, b.num_rows, 512):
                part.append(beam_encode(_matrix(b.column(1).slice(lo, 512), d), books, beam))
            if not part:
                continue
            codes, gain = (np.concatenate([p[i] for p in part]) for i in (0, 1))
            norm = np.sqrt((approximate(codes, gain, books) ** 2).sum(1))
            stored = np.stack([gain, norm], 1)  # of each row
            ids = b.column(0).to_numpy()
            for k in np.unique(block).tolist():
                at = block == k
                yield blob(k, None, ids[at], codes[at].tobytes(), stored[at].astype("<f4").tobytes())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, ids, x = b.column(2).to_numpy(), b.column(0).to_numpy(), _matrix(b.column(1), d)
            for k in np.unique(block).tolist():
                at = block == k
                yield blob(None, k, ids[at], x[at].astype("<f4").tobytes(), b"")

    def blob(row: int | None, query: int | None, ids: np.ndarray, data: bytes, norms: bytes) -> pa.RecordBatch:
        cols = [pa.array([row], pa.int32()), pa.array([query], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([data]), pa.array([norms])]
        return pa.RecordBatch.from_arrays(cols, names=["row", "query", "ids", "data", "norms"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for r in packed.rows_of(batches):
            if (r["row"], r["query"]) != at:
                yield from cell(held)
                at, held = (r["row"], r["query"]), []
            held.append(r)
        yield from cell(held)

    def cell(held: list[dict]) -> Iterator[pa.RecordBatch]:
        kinds = [[r for r in held if bool(r["norms"]) is flag] for flag in (True, False)]
        if not all(kinds):
            return
        ids, asked_ids = (np.frombuffer(b"".join(r["ids"] for r in rs), "<i8") for rs in kinds)
        codes = np.frombuffer(b"".join(r["data"] for r in kinds[0]), np.uint8).reshape(-1, stages)
        gain, norm = np.frombuffer(b"".join(r["norms"] for r in kinds[0]), "<f4").reshape(-1, 2).T
        x = np.frombuffer(b"".join(r["data"] for r in kinds[1]), "<f4").reshape(-1, d)
        turned = np.ascontiguousarray(codes.T)
        scale = 1 / np.maximum(norm, 1e-12)
        for lo in range(0, len(x), 32):
            look = np.einsum("qd,mkd->qmk", x[lo : lo + 32], books, optimize=True)
            out_q, out_v = [], []
            for i in range(len(look)):
                score = np.zeros(len(ids), np.float32)
                for m in range(1, stages):
                    score += look[i, m][turned[m]]
                score = (look[i, 0][turned[0]] + gain * score) * scale
                score[ids == asked_ids[lo + i]] = -np.inf
                best = _best(score, ids, shortlist)
                best = best[score[best] > -np.inf]
                out_q.append(np.full(len(best), asked_ids[lo + i]))
                out_v.append(ids[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v))], names=["query_id", "vec_id"])

    kind = "row int, query int, ids binary, data binary, norms binary"
    encoded = packed.arrow_map(rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("block")), index, kind)
    wanted = packed.arrow_map(asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("block")), ask, kind)
    encoded = encoded.withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    wanted = wanted.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    cells = row_blocks * query_blocks
    dealt = encoded.unionByName(wanted).repartitionById(min(cells, packed.n_parts(spark)), F.pmod(F.col("row") * query_blocks + F.col("query"), F.lit(min(cells, packed.n_parts(spark)))))
    pairs = packed.arrow_map(dealt.sortWithinPartitions("row", "query"), meet, "query_id long, vec_id long")
    near = pairs.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), F.col("norm").alias("asked_norm")), "query_id")
    scored = near.select("query_id", "vec_id", (_dot(F.col("v"), F.col("w")) / (F.col("norm") * F.col("asked_norm"))).alias("score"))
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
