"""Line dedup, Jaccard join, suffix dedup, scoring, neighbours and the pipeline against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeledger.llm import graph, induced, jaccard, lines, neighbours, packed, scoring, suffixes

rng = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in ("the", "ou", "ing", "é", "st", "br") for b in ("", "an", "er", "on", "ti", "ß", "qu")]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = "\n".join(prose(40) for _ in range(4)), prose(60)
    texts = [None, "", " \n ", "one", "One", "two words", base, base, base, *(edited(base, k) for k in (1, 1, 2, 4, 8, 30)), passage + "\n" + prose(30), prose(25) + " " + passage, passage[:200], "a" * 400, "a" * 120, "short\nshort\n \nshort ", "short", *(prose(rng.randrange(1, 90)) for _ in range(30)), prose(4000)]
    rows = [(i * 3, x, "clash", 0) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, root string, n_chars long").repartition(5)


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def shingle_sets(texts, width):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = {}
    for d, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)  # groups of several blocks
    sets = shingle_sets(texts_of(docs), width)
    groups = Groups(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark, docs, width, percent).collect()}
    assert got == {d: (len(s), groups.root(d)) for d, s in sets.items()}


def test_keep_one_keeps_columns_and_singles(spark, docs):
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 18 in ids and not {21, 24} & ids and {0, 3, 6} <= ids
    assert jaccard.jaccard_components(spark, docs.limit(0)).count() == 0


def test_prefix_tree_finds_all_links():
    r = np.random.default_rng(2)
    for percent in (50, 80, 90):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(60)]
        groups, found = Groups(range(60)), Groups(range(60))
        for a in range(60):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    groups.join(a, b)
        for a, b in jaccard.links_in_group(list(range(60)), [len(s) for s in sets], sets, None, percent):
            found.join(a, b)
        assert [groups.root(x) for x in range(60)] == [found.root(x) for x in range(60)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3), (-5, 100)]
    got = {r["vertex"]: r["root"] for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: -5 for i in (-5, 100, 101, 103)}}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_LINES", 3)
    space, sets, places = " \t\n\r\x0b\x0c", {}, {}
    texts = texts_of(docs)
    for d in sorted(texts):
        for k, line in enumerate((texts[d] or "").split("\n")):
            if line := line.strip(space):
                sets[line] = {line[i : i + lines.WIDTH] for i in range(max(1, len(line) - lines.WIDTH + 1))}
                places.setdefault(line, []).append((d, k))
    groups = Groups(sets)
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    first = {}
    for line, at in places.items():
        first[groups.root(line)] = min([first.get(groups.root(line), at[0]), *at])
    gone = {p for line, at in places.items() for p in at if p != first[groups.root(line)]}
    for few in (10**6, 0):  # places by broadcast, and by a shuffle
        monkeypatch.setattr(lines, "BROADCAST_LINES", few)
        got = {r["doc_id"]: r for r in lines.dedup_lines(spark, docs).collect()}
        for d, x in texts.items():
            kept = None if x is None else "\n".join(v for k, v in enumerate(x.split("\n")) if (d, k) not in gone)
            assert got[d]["text"] == kept and got[d]["n_removed"] == sum(p[0] == d for p in gone) and got[d]["root"] == "clash"
    assert lines.dedup_lines(spark, docs.limit(0)).count() == 0


def brute_spans(texts, length=50):
    first, out = {}, {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    for d, x in texts.items():
        raw = (x or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
    return out


@pytest.mark.parametrize("budget", [64 << 20, 1000])
def test_suffix_dedup(spark, docs, budget, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "STRINGS", 100)
    rows = suffixes.removed_spans(spark, docs.union(spark.createDataFrame([(None, "a" * 400, "x", 0)], docs.schema)), 50, budget).collect()
    got = {r["doc_id"]: [tuple(p) for p in np.frombuffer(r["spans"] or b"", "<i8").reshape(-1, 2).tolist()] for r in rows if r["doc_id"] is not None}
    assert got == brute_spans(texts_of(docs))
    assert [r["spans"] for r in rows if r["doc_id"] is None] == [None]


def test_passages_go_by_whole_characters(spark, docs):
    spans, texts = brute_spans(texts_of(docs)), texts_of(docs)
    got = texts_of(suffixes.dedup_passages(spark, docs))
    for d, x in texts.items():
        at, kept = 0, []
        for c in x or "":
            n = len(c.encode())
            if not any(lo <= at and at + n <= hi for lo, hi in spans[d]):
                kept.append(c)
            at += n
        assert got[d] == (None if x is None else "".join(kept))
    assert suffixes.dedup_passages(spark, docs.limit(0)).count() == 0


def test_rows_that_repeat_a_doc_id(spark):
    """Each row is judged by its own text, whatever other rows its doc_id has."""
    passage, other = prose(60), prose(90)
    rows = [(1, passage), (2, f"before {passage} behind"), (2, other), (2, "short"), (2, "short"), (None, passage), (3, None), (3, ""), (3, other + " more")]
    frame = spark.createDataFrame([(d, x, k, k, k) for k, (d, x) in enumerate(rows)], "doc_id long, text string, spans int, row_keys int, keys int")
    first = {}
    for d, x in rows:
        raw = (x or "").encode()
        for i in range(len(raw) - 49):
            if d is not None:
                first[raw[i : i + 50]] = min(d, first.get(raw[i : i + 50], d))
    got = {r["keys"]: r for r in suffixes.dedup_passages(spark, frame).collect()}
    spans = {r["rest"]["keys"]: np.frombuffer(r["spans"] or b"", "<i8").reshape(-1, 2).tolist() for r in suffixes.removed_spans(spark, frame).collect()}
    for k, (d, x) in enumerate(rows):
        raw = (x or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        assert spans[k] == [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(gone))]
        assert got[k]["doc_id"] == d and got[k]["row_keys"] == k
        assert len(got[k]["text"] or "") <= len(x or "") and (got[k]["text"] == x if not spans[k] else got[k]["text"] != x)
    assert got[2]["text"] == other and got[3]["text"] == got[4]["text"] == "short" and got[5]["text"] == passage


def test_one_row_of_equal_rows_stays(spark):
    a, b = prose(40), prose(40)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, b), (4, ""), (4, ""), (5, None), (3, "lone words"), (3, "lone words")]
    frame = spark.createDataFrame([(d, x, str(k)) for k, (d, x) in enumerate(rows)], "doc_id long, text string, least string")
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark, frame).collect())
    assert kept == Counter([(1, a), (1, b), (4, ""), (4, ""), (5, None), (3, "lone words")])
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark, frame).collect())
    assert got == Counter([(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, 1), (4, 4), (4, 4), (5, 5), (3, 3), (3, 3)])
    lined = {r["least"]: r for r in lines.dedup_lines(spark, frame).collect()}
    assert lined["4"]["text"] == a and lined["4"]["n_removed"] == 0 and lined["3"]["text"] == "" and lined["0"]["text"] == a and lined["8"]["text"] is None


@pytest.mark.parametrize("each", [80, 10**9])
def test_induced_sorting(each, monkeypatch):
    monkeypatch.setattr(induced, "NAME_BYTES", each)
    for trial in range(120):
        alphabet = rng.choice([2, 3, 5, 200])
        strings = [bytes(rng.randrange(1, alphabet + 1) for _ in range(rng.randrange(1, rng.choice([4, 30, 80])))) for _ in range(rng.randrange(1, 30))]
        strings += strings[:3] if trial % 3 == 0 else [b"\1" * 60]
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        got = list(induced.suffixes(text, 20, rng.choice([100, 10**6])))
        got = np.concatenate(got) if got else np.zeros(0, induced.kind(text))
        tails = sorted((s[i:], k) for k, s in enumerate(strings) for i in range(len(s)))
        raw = text.tobytes()
        assert [raw[p : raw.index(0, p)] for p in got["pos"].tolist()] == [t for t, _ in tails]
        for k in range(1, len(tails)):
            assert got["lcp"][k] == min(20, len(os.path.commonprefix([tails[k - 1][0], tails[k][0]])))


@pytest.mark.parametrize("budget", [500, 10**7])
def test_induced_sorting_of_many_names(budget, monkeypatch):
    """Large alphabets: groups of several characters, far groups dealt later, spilled queues, several levels."""
    monkeypatch.setattr(induced, "NAME_BYTES", 10**5)
    monkeypatch.setattr(induced, "CHUNK", 300)
    g = np.random.default_rng(4)
    part = g.integers(1, 6000, 40)
    strings = [[int(x) for x in g.integers(1, 6000, 8000)], [3, 3, 3, 7, 7, 3] * 60, *[list(map(int, part[k:])) for k in range(30)], list(range(1, 700)), list(range(700, 0, -1))]
    text = np.array([x for s in strings for x in (*s, 0)], np.uint32)
    ends = np.flatnonzero(text == 0)
    levels = []
    whole = induced.suffixes
    monkeypatch.setattr(induced, "suffixes", lambda t, *more: levels.append(len(t)) or whole(t, *more))
    got = np.concatenate(list(whole(text, 20, budget)))
    tail = lambda p: text[p : ends[np.searchsorted(ends, p)]].tolist()
    want = sorted((tail(p), p) for p in np.flatnonzero(text).tolist())
    assert got["pos"].tolist() == [p for _, p in want] and len(levels) >= 1
    for k in range(1, len(want)):
        a, b = want[k - 1][0], want[k][0]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got["lcp"][k] == min(20, same)


def test_packed_values():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (packed.expand(packed.squeeze(keys)) == keys).all() and len(packed.expand(packed.squeeze(keys[:0]))) == 0
    edge = packed.bounds(keys, 7)
    assert all(((keys[a:b] >> np.uint64(32)) * np.uint64(7) >> np.uint64(32) == k).all() for k, (a, b) in enumerate(zip(edge, edge[1:])))


def test_line_places_decide_the_broadcast(spark, monkeypatch):
    same = "the same templated line with many words and the number "
    docs = spark.createDataFrame([(i, f"{same * 3}{i}") for i in range(20)], "doc_id long, text string")
    asked = []
    texts = lines._texts
    monkeypatch.setattr(lines, "_texts", lambda docs, wanted, few: asked.append((wanted.count(), few)) or texts(docs, wanted, few))
    whole = {r["root"] for r in lines.line_components(spark, docs).collect()}
    n, few = asked.pop()
    assert few and n >= 20 and len(whole) == 1
    monkeypatch.setattr(lines, "BLOCK_LINES", 3)
    monkeypatch.setattr(lines, "BROADCAST_LINES", n)  # as many as there are lines in groups, before they are dealt into blocks
    assert {r["root"] for r in lines.line_components(spark, docs).collect()} == whole
    places, few = asked.pop()
    assert places > n and not few
    monkeypatch.setattr(lines, "BROADCAST_LINES", places)
    lines.line_components(spark, docs)
    assert asked.pop() == (places, True)


def test_scores(spark, docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(5, "twin"), (5, "twin"), (None, "lost"), (6, "TWIN twin")], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low)), None] for _, x in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    expected = Counter((d, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _), t, h in zip(rows, tokens, held))
    got = scoring.score_texts(spark, more).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert scoring.score_texts(spark, more.limit(0)).count() == 0


def model_of(rows, weight=scoring.WEIGHT):
    """p(w | u) of the documented model with exact counts, quantised by hand; its vocabulary; tokens by document."""
    tokens = [[None, *x.split(" "), None] for _, x in rows]
    learn = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    one = Counter(w for t, h in zip(tokens, learn) if h for w in t[1:])
    two = Counter(p for t, h in zip(tokens, learn) if h for p in zip(t, t[1:]))
    total = sum(one.values()) + len(one) + 1

    def words(c):  # smallest and largest count of a level, four levels a doubling
        if not c:
            return 0, 0
        same = [k for k in range(1, 4 * c + 5) if math.floor(4 * math.log2(k) + 1e-9) == math.floor(4 * math.log2(c) + 1e-9)]
        return same[0], same[-1]

    def p(u, w):
        low = (one[w] if w is None else words(one[w])[0]) + 1
        before = one[u] if u is None else words(one[u])[1]
        both = 1 << (two[u, w].bit_length() - 1) if two[u, w] else 0
        return (1 - weight) * low / total + weight * min(both, before) / before if before else low / total

    return p, one, two, tokens


def test_scores_are_the_models(spark):
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(12))) for i in range(80)]
    p, one, two, tokens = model_of(rows)
    expected = {d: sum(math.log10(p(u, w)) for u, w in zip(t, t[1:])) for (d, _), t in zip(rows, tokens)}
    got = {r["doc_id"]: r["score"] for r in scoring.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), bits=64).collect()}
    assert sum(c == 1 for c in two.values()) > 50 and set(got) == set(expected)
    assert sum(abs(got[d] - expected[d]) < 1e-9 for d in got) >= 78  # a filter may see what isn't there, seldom
    for u in [*one, "unseen"]:  # a word's successors have a probability of 1 at most, and most of it
        assert 0.3 < sum(p(u, w) for w in [*one, "unseen"]) <= 1 + 1e-12


def test_scores_follow_the_corpus_beyond_the_broadcast_bound(spark, docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(5, "twin"), (5, "twin"), (None, "lost"), (6, "TWIN twin")], "doc_id long, text string"))
    seen = lambda **bound: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in scoring.score_texts(spark, more, **bound).collect())
    assert seen(max_filter_mb=0) == seen() and sum(seen(max_filter_mb=0).values()) == more.count()
    assert scoring.score_texts(spark, more.limit(0), max_filter_mb=0).count() == 0


def test_filter_bound():
    counts = np.arange(1, 5000)
    assert (scoring.quantised(counts, 1) <= counts).all() and (scoring.quantised(counts, 4) <= 2.5 * counts).all()
    r = np.random.default_rng(5)
    for many in (1, 40, 3000):
        words = r.integers(0, many, 4000)
        one, two = (np.unique(x, return_counts=True)[1] for x in (words, words[1:] * many + words[:-1]))
        levels = np.concatenate([scoring.quantised(one, 4), scoring.quantised(two, 1)])
        keys = np.unique(r.integers(0, 2**63, 2 * len(levels), dtype=np.uint64))[: len(levels)]
        assert len(scoring.Filter.segment(keys, levels, 14)) <= scoring.filter_bound(len(words), 14, 1)


def test_filter_counts():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = r.integers(1, 3000, len(keys))
    for steps in (1, 4):
        level = scoring.quantised(counts, steps)
        low, high = scoring.range_of(level, steps)
        assert (low <= counts).all() and (counts <= high).all() and (high < low * 2 ** (1 / steps) + 1).all()
        edge = packed.bounds(keys, 4)
        parts = [scoring.Filter.segment(keys[a:b], level[a:b], 14) for a, b in zip(edge, edge[1:])]
        f = scoring.Filter(b"".join(parts), np.concatenate([[0], np.cumsum([8 * len(p) for p in parts])]), int(level.max()))
        got = f.levels(keys)
        assert (got >= level).all() and (got == level).mean() > 0.99  # never less than what is stored
        assert (f.levels(keys + np.uint64(1)) > 0).mean() < 0.01
    full = scoring.Filter(b"\xff" * 512, np.array([0, 4096]), 7)
    assert (full.levels(keys) == 7).all()  # ends


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1200, 16))
    x[600:640] = x[600]
    x[700:760] = x[700] + 0.01 * r.normal(size=(60, 16))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], "clash") for i in range(len(x))]
    rows += [(5000, None, ""), (5001, [0.0] * 16, ""), (5002, [float("nan")] * 16, ""), (5003, [1.0, None] + [1.0] * 14, ""), (5004, [float("inf")] * 16, ""), (5005, [], ""), (5050, [1.0] * 3, ""), (650, rows[650][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = neighbours.search(spark, df, F.col("vec_id") % 50 == 0, stages=6, words=32, shortlist=150).collect()
    v = np.array([row[1] for row in rows[:1200]], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    by, hits = {}, 0
    for row in got:
        by.setdefault(row["query_id"], []).append(row)
    assert set(by) == set(range(0, 1200, 50))
    for q, mine in by.items():
        mine.sort(key=lambda row: row["rank"])
        assert [row["rank"] for row in mine] == [1, 2, 3, 4, 5] and q not in [row["vec_id"] for row in mine]
        score = v @ v[q]
        assert all(abs(row["score"] - score[row["vec_id"]]) < 1e-9 for row in mine)
        score[q] = -9
        hits += len({row["vec_id"] for row in mine} & set(np.lexsort((np.arange(1200), -np.round(score, 12)))[:5].tolist()))
    assert hits / (5 * len(by)) >= 0.9
    assert [row["vec_id"] for row in by[600]] == [601, 602, 603, 604, 605]
    assert neighbours.search(spark, df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(spark, df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_pipeline(spark, tmp_path):
    base = "\n".join(prose(30) for _ in range(3))
    texts = [base, base, edited(base, 2), *("\n".join(prose(25) for _ in range(3)) for _ in range(20)), "bad*** " * 50, "tiny"]
    frame = spark.createDataFrame([(i, x, "en", "src", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 23), 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "suffix_dedup", "packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == frame.columns
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            seen.append({r["doc_id"]: r for r in docs.collect()})
            assert all(r["n_chars"] == len(r["text"]) for r in seen[-1].values())
    assert set(seen[0]) == set(range(23))
    assert 1 not in seen[1] and set(range(3, 23)) | {0} <= set(seen[3])
    assert {r["doc_id"] for r in docs.collect()} == set(seen[3])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[3])


def test_pipeline_with_odd_rows(spark, tmp_path):
    base = "\n".join(prose(30) for _ in range(3))
    rows = [(1, base, "en", "s", 1, "a"), (1, base, "en", "s", 1, "b"), (None, prose(40), None, None, None, None), (3, None, "en", "s", 0, ""), (4, "", "en", "s", 0, ""), (5, prose(9000), "en", "s", 0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, least string"
    for k, (data, labels) in enumerate(((rows, [(1, 1, 0), (5, 0, 0)]), ([], []))):
        place = tmp_path / str(k)
        spark.createDataFrame(data, schema).write.parquet(str(place / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(place)).collect()
        assert {r["doc_id"] for r in got} <= {1, 5, None} and sum(r["start"] == 0 for r in got if r["doc_id"] == 1) <= 1
        assert bool(got) == bool(data)
