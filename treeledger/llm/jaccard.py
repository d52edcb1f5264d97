"""N-gram Jaccard join: exact, over globally ordered n-gram sets in prefix trees.

Documents with equal sets form a class.  The steps:

1. Shingles of all texts are exchanged by value; each value's document frequency over classes is counted.
2. What is left of each class is its number of unique shingles and its shared ones, in the global order (rarest first,
   ties by value).  Two sets can only link if they share one of the first ``n - need + 1`` shingles of either; a class
   whose unique shingles fill that prefix has no partner and goes no further.
3. Shared prefix shingles join the classes left into groups (distributed union-find over one star per shingle); links
   never leave a group.
4. The sets of a group go into a prefix tree (a large group is dealt into blocks, each pair of blocks a tree of its own).
   Each set walks the tree; what nodes share is counted once, and a subtree ends where the overlap so far and the
   shorter of both remainders can't reach the bound, or where all its sets are linked with this one already.
5. Distributed union-find over the links; a class's component is the smallest doc_id reachable.

No pairs of a group are written, only a forest of links; no shingle, partner or candidate is capped.

Shingles and classes are known by 64-bit hashes.  Defined results: null texts and texts without words have an empty set
and are linked with nothing; a text with fewer words than a shingle has them all as its one shingle; repeated rows link;
an empty table gives an empty result; other columns are ignored.  A row with a null doc_id links like any other and
names no component: its component_id is the smallest doc_id that it reaches, or null.  Rows that share a doc_id are rows
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, packed
from . import textbytes as tb

U64 = np.uint64
SLICE = 2 << 20
#: Bytes of sets in a block of a group.
BLOCK_BYTES = 8 << 20
#: Rows of small groups that are compared in one call.
GROUP_ROWS = 1500


def shingles(s: tb.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted by value, and their documents."""
    lo, hi, doc = s.words()
    word = s.hashes(lo, hi)
    gram, at = tb.windows(word, doc, width)
    owner = doc[at]
    n_words = np.bincount(doc, minlength=s.n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        own = np.array([hash_of(word[first[d] : first[d + 1]]) for d in short.tolist()], U64)
        gram, owner = np.concatenate([gram, own]), np.concatenate([owner, short])
    order = np.argsort(gram)
    gram, owner = gram[order], owner[order]
    same = gram[1:] == gram[:-1]
    near = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(near):
        key = np.lexsort((owner[near], gram[near]))
        owner[near] = owner[near][key]
        twice = near[1:][(gram[near][1:] == gram[near][:-1]) & (owner[near][1:] == owner[near][:-1])]
        keep = np.ones(len(gram), bool)
        keep[twice] = False
        gram, owner = gram[keep], owner[keep]
    return gram, owner


def hash_of(words: np.ndarray) -> np.uint64:
    out = np.full(1, len(words), U64)
    for w in words:
        out = tb.mix(out * U64(0xD1342543DE82EF95) + w)
    return out[0]


def classes(gram: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each document's set, and the set's size."""
    size = np.bincount(owner, minlength=n)
    parts = np.zeros((2, n), U64)
    np.add.at(parts[0], owner, tb.mix(gram))
    np.add.at(parts[1], owner, tb.mix(gram ^ U64(0x9E3779B97F4A7C15)))
    return tb.mix(tb.mix(parts[0]) ^ (parts[1] * U64(3) + size.astype(U64))), size


def _document_classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), class (null for an empty set) and n_shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(tb.as_bytes(b.column(1)), True, SLICE):
                cls, size = classes(*shingles(s, width), s.n)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(s.lo, s.n), "text_key": b.column(2).slice(s.lo, s.n), "class": pa.array(cls.view(np.int64), mask=size == 0), "n_shingles": pa.array(size.astype(np.int64))})

    return packed.arrow_map(docs.select("doc_id", "text", F.xxhash64("text")), run, "doc_id long, text_key long, class long, n_shingles long")


def _by_shingle(docs: DataFrame, width: int, n: int) -> DataFrame:
    """Blobs (part, keys, owners, classes) of the shingles of a slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(tb.as_bytes(b.column(1)), True, SLICE):
                gram, owner = shingles(s, width)
                cls, _ = classes(gram, owner, s.n)
                first = np.unique(cls, return_index=True)[1]  # one document of each class
                keep = np.zeros(s.n, bool)
                keep[first] = True
                keep = keep[owner]
                gram, owner = gram[keep], owner[keep]
                edge = packed.bounds(gram, n)
                out = []
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    g, o = gram[edge[k] : edge[k + 1]], owner[edge[k] : edge[k + 1]]
                    here, local = np.unique(o, return_inverse=True)
                    out.append((k, packed.squeeze(g), packed.planes(local, "<u4"), cls[here].astype("<u8").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["part", "keys", "owners", "classes"]).cast(pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("classes", pa.binary())]))

    return packed.arrow_map(docs.select("doc_id", "text"), run, "part int, keys binary, owners binary, classes binary")


def _by_class(blobs: DataFrame, n: int) -> DataFrame:
    """Counts document frequencies; blobs (part, classes, unique, counts, keys, df): per class its unique and shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cls = [], []
        for row in packed.rows_of(batches):
            keys.append(packed.expand(row["keys"]))
            cls.append(np.frombuffer(row["classes"], "<u8")[packed.unplanes(row["owners"], "<u4")])
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(cls)
        del keys, cls
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[keep], owner[keep]
        at = packed.starts(key)
        df = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
        order = np.argsort(owner, kind="stable")
        key, owner, df = key[order], owner[order], df[order]
        edge = packed.bounds(owner, n)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            q, o, d = key[edge[k] : edge[k + 1]], owner[edge[k] : edge[k + 1]], df[edge[k] : edge[k + 1]]
            at = packed.starts(o)
            shared = d > 1
            total = np.diff(np.append(at, len(o)))
            count = np.add.reduceat(shared.astype(np.int64), at)
            cols = [pa.array([k], pa.int32()), pa.array([packed.squeeze(o[at])]), pa.array([packed.planes(total - count, "<u4")]), pa.array([packed.planes(count, "<u4")]), pa.array([q[shared].astype("<u8").tobytes()]), pa.array([packed.planes(d[shared], "<u4")])]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "classes", "unique", "counts", "keys", "df"])

    return packed.arrow_map(packed.deal(blobs, n), run, "part int, classes binary, unique binary, counts binary, keys binary, df binary")


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n needs with any partner: with one of size m >= percent% of n, J * (n + m) / (1 + J) >= J * n."""
    return -(-percent * n // 100)


def _candidates(by_class: DataFrame, n: int, percent: int) -> DataFrame:
    """class, n, prefix (array of shared shingles in the prefix), keys and df (shared shingles in the global order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for row in packed.rows_of(batches):
            cls, count = packed.expand(row["classes"]), packed.unplanes(row["counts"], "<u4").astype(np.int64)
            parts.append((cls, packed.unplanes(row["unique"], "<u4").astype(np.int64), count, np.frombuffer(row["keys"], "<u8"), packed.unplanes(row["df"], "<u4")))
        if not parts:
            return
        all_cls = np.concatenate([p[0] for p in parts])
        ids, where = np.unique(all_cls, return_inverse=True)
        unique = np.zeros(len(ids), np.int64)
        np.add.at(unique, where, np.concatenate([p[1] for p in parts]))
        counts = np.concatenate([p[2] for p in parts])
        shared = np.zeros(len(ids), np.int64)
        np.add.at(shared, where, counts)
        size = unique + shared
        prefix = size - -(-percent * size // 100) + 1 - unique
        owner = np.repeat(where, counts)
        keep = (prefix > 0)[owner]
        owner = owner[keep]
        key = np.concatenate([p[3] for p in parts])[keep]
        df = np.concatenate([p[4] for p in parts])[keep]
        del parts
        order = np.lexsort((key, df, owner))
        key, df, owner = key[order], df[order], owner[order]
        at = packed.starts(owner)
        end = np.append(at[1:], len(owner))
        for lo in range(0, len(at), 500):
            rows = [(int(ids[owner[a]].view(np.int64)), int(size[owner[a]]), key[a : min(e, a + prefix[owner[a]])].view(np.int64).tolist(), key[a:e].tobytes(), df[a:e].astype("<u4").tobytes()) for a, e in zip(at[lo : lo + 500].tolist(), end[lo : lo + 500].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=["class", "n", "prefix", "keys", "df"])

    return packed.arrow_map(packed.deal(by_class, n), run, "class long, n long, prefix array<long>, keys binary, df binary")


class Forest:
    """Union-find over a few sets, by labels: the smaller component takes the larger one's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[k] for k in range(n)]

    def join(self, x: int, y: int) -> None:
        x, y = int(self.label[x]), int(self.label[y])
        if x != y:
            x, y = (x, y) if len(self.members[x]) >= len(self.members[y]) else (y, x)
            self.label[self.members[y]] = x
            self.members[x] += self.members[y]
            self.members[y] = []

    def stars(self, cls: list[int]) -> list[tuple[int, int]]:
        """Each set's class with the smallest class of its component."""
        return [(cls[k], low) for own in self.members if len(own) > 1 for low in [min(cls[k] for k in own)] for k in own if cls[k] != low]


class PrefixTree:
    """Sets of ranks in ascending order, as a path-compressed tree over their sorted sequences.

    A node is (lo, hi, depth, end, children): the sequences lo..hi-1 share the ranks depth..end-1.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        common = [0]
        for x, y in zip(sets, sets[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = np.array(common, np.int64)
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []
        self.longest: list[int] = []
        self.smallest: list[int] = []
        self.top = self.build()

    def build(self) -> int:
        root, todo = -1, [(0, len(self.sets), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(self.sets[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
            here = len(self.nodes)
            self.nodes.append((lo, hi, depth, end, []))
            self.longest.append(max(map(len, self.sets[lo:hi])))
            self.smallest.append(int(self.sizes[lo:hi].min()))
            if parent >= 0:
                self.nodes[parent][4].append(here)
            else:
                root = here
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(self.common[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
                todo += [(a, b, end, here) for a, b in zip(cuts, cuts[1:])]
        return root

    def walk(self, probe: np.ndarray, size: int, me: int, flags: np.ndarray, percent: int, forest: Forest, offer) -> None:
        """Calls offer(i) for the sets that link with the probe, but for those that are linked with it already."""
        flags[probe] = True
        todo = [(self.top, 0)]
        while todo:
            at, overlap = todo.pop()
            lo, hi, depth, end, children = self.nodes[at]
            if (forest.label[lo:hi] == forest.label[me]).all():
                continue
            first = self.sets[lo]
            overlap += int(np.count_nonzero(flags[first[depth:end]]))
            left = len(probe) - (int(np.searchsorted(probe, first[end - 1], side="right")) if end else 0)
            need = -(-percent * (size + self.smallest[at]) // (100 + percent))
            if overlap + min(left, self.longest[at] - end) < need:
                continue
            if hi - lo == 1 or not children:
                for i in range(lo, hi):
                    if len(self.sets[i]) == end and (100 + percent) * overlap >= percent * (size + int(self.sizes[i])):
                        offer(i)
            todo += [(c, overlap) for c in children]
        flags[probe] = False


def links_in_group(cls: list[int], sizes: list[int], keys: list[np.ndarray], dfs: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """The components of a group's links, as links of each set with the smallest class of its component; without document
    frequencies the order is by value alone."""
    key = np.concatenate(keys)
    df = np.concatenate(dfs) if dfs is not None else np.zeros(len(key), np.uint32)
    order = np.lexsort((key, df))
    fresh = np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (df[order][1:] != df[order][:-1])])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(fresh)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    sets = [rank[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    by = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    sets, sizes, cls = [sets[i] for i in by], np.array([sizes[i] for i in by], np.int64), [cls[i] for i in by]
    tree, forest = PrefixTree(sets, sizes), Forest(len(sets))
    flags = np.zeros(int(rank.max(initial=-1)) + 1, bool)
    for me, probe in enumerate(sets):
        tree.walk(probe, int(sizes[me]), me, flags, percent, forest, lambda i, me=me: forest.join(me, i))
    return forest.stars(cls)


def candidate_groups(spark: SparkSession, found: DataFrame) -> DataFrame:
    """vertex and root of the classes that share a value of prefix with another class."""
    tokens = found.select("class", F.explode("prefix").alias("shingle"))
    least = tokens.groupBy("shingle").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return graph.components(spark, tokens.join(least, "shingle").where("class <> b").select(F.col("class").alias("a"), "b").distinct())


def block_pairs(members: DataFrame, weight: Column, block: int) -> DataFrame:
    """members with blocks, mine and other: root is dealt into blocks of about that weight, and each pair of blocks meets."""
    size = members.groupBy("root").agg(F.ceil(F.sum(weight) / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def links(pairs: DataFrame, n: int, columns: tuple[str, ...], compare) -> DataFrame:
    """a, b: what compare gives for some groups; a group has the rows (as tuples of columns) of a pair of blocks of a root."""
    dealt = pairs.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *columns)
    dealt = dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, groups, size = None, [], [], 0
        for row in packed.rows_of(batches):
            key = (row["root"], row["i"], row["j"])
            if key != at:
                groups += [held] if len(held) > 1 else []
                size += len(held)
                at, held = key, []
                if size >= GROUP_ROWS:
                    yield from found(groups)
                    groups, size = [], 0
            held.append(tuple(row[c] for c in columns))
        yield from found([*groups, held] if len(held) > 1 else groups)

    def found(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        got = compare(groups) if groups else []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return packed.arrow_map(dealt, run, "a long, b long")


def _links(spark: SparkSession, found: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links between classes, a forest for each pair of blocks of a group."""
    members = found.select("class", "n", "keys", "df").join(candidate_groups(spark, found).withColumnRenamed("vertex", "class"), "class")

    def compare(groups: list[list[tuple]]) -> list[tuple[int, int]]:
        out = []
        for cls, sizes, keys, dfs in (zip(*g, strict=True) for g in groups):
            out += links_in_group(cls, sizes, [np.frombuffer(x, "<u8") for x in keys], [np.frombuffer(x, "<u4") for x in dfs], percent)
        return out

    return links(block_pairs(members, F.length("keys"), BLOCK_BYTES), n, ("class", "n", "keys", "df"), compare)


def class_roots(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """vertex and root of the classes of docs that link with another class."""
    n = packed.n_parts(spark)
    graph.checkpoint_dir(spark)
    found = _candidates(_by_class(_by_shingle(docs, width, n), n), n, percent).checkpoint()
    return graph.components(spark, _links(spark, found, n, percent))


def _least(rows: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """class and least (over its component) of the classes with several rows or links.

    One row a class takes part in the join by root, however many documents have it.
    """
    each = rows.where("class is not null").groupBy("class").agg(least.alias("own"), F.count(F.lit(1)).alias("rows"))
    each = each.join(roots.withColumnRenamed("vertex", "class"), "class", "left").where("root is not null or rows > 1").checkpoint()
    low = each.where("root is not null").groupBy("root").agg(F.min("own").alias("least")).checkpoint()
    return each.join(low, "root", "left").select("class", F.coalesce("least", "own").alias("least"))


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least percent% Jaccard)."""
    roots = class_roots(spark, docs, width, percent)
    rows = _document_classes(docs, width).checkpoint()  # a few bytes a document; the texts are not shingled again
    return rows.join(_least(rows, roots, F.min("doc_id")), "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: of the smallest doc_id (null comes last), then of
    the smallest hash of its text; of rows that are equal in both any one.  Rows without words stay as they are."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    roots = class_roots(spark, docs, width, percent)
    rows = _document_classes(docs, width).checkpoint()
    marked = rows.join(_least(rows, roots, F.min(key)), "class").select("doc_id", "text_key", (~key.eqNullSafe(F.col("least"))).alias("goes"))
    marked = marked.groupBy("doc_id", "text_key", "goes").agg(F.count(F.lit(1)).alias("rows")).where("goes or rows > 1").checkpoint()

    def of(frame: DataFrame, kind: str) -> DataFrame:
        same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_key"))
        return docs.alias("d").join(frame.alias("m"), same, kind).select("d.*")

    repeated = marked.where("not goes")
    kept = of(marked, "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(of(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
