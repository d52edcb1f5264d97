"""Pieces, chat, packing, licenses and quality against libraries and brute force."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeledger.llm import chat, licenses, packing, pieces, quality
from treeledger.llm import textbytes as tb

ODD = [
    None, "", " ", "  a b", "a\nb  c ", "<s>x</s>", "a\x00b", "é😀 😀漢", "▁x ▁", "▁", "a　b", "\n", "\r\n x", "x" * 5000, "İstanbul ΣΑΣ. ...,, x.,y 12,3 ２３",
    "It's a DON'T, we'll do\tb\x0bc\x1cd\xa0e f", "<|endoftext|> a", "ß.,ẞ º, µ. ÿ Ÿ ﬁ ª", "x ́ y", "a\x85b", "The.The don't,", "same text", "same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "clash", i) for i, x in enumerate(ODD)] + [(7, "repeated id", "clash", 1), (None, "no id", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_pieces_equal_the_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode(docs, path, ("ids", "ids_text", "decoded"))
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    expected = Counter((d, ",".join(map(str, model.encode(x or ""))), model.decode(model.encode(x or ""))) for d, x in [(r["doc_id"], r["text"]) for r in docs.collect()])
    got = encoded.collect()
    assert Counter((r["doc_id"], r["ids_text"], r["decoded"]) for r in got) == expected and texts
    assert all(r["n_tokens"] == len(r["ids"]) and ",".join(map(str, r["ids"])) == r["ids_text"] for r in got)
    assert Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, path).collect()) == Counter((d, t) for d, _, t in expected.elements())
    assert pieces.encode(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, path, ("other",))


def test_piece_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 5)
    t = pieces.ChunkTable(public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(9):
        cut = t.cut(f"a{k} b{k} c ")
        t.learn([cut])
        assert len(t.ids) <= 5 + 4 and ",".join(t.ids[x] for x in cut) == ",".join(map(str, t.model.encode(f"a{k} b{k} c ")))


def check_packing(rows, texts, capacity, end):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, x in texts.items():
        ids = np.array([*model.encode(x or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for pieces_ in by_seq.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        total += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded, total


def test_packing_covers_every_token_once(spark, docs):
    some = docs.where("doc_id is not null and ids = 'clash' and text <> 'repeated id' or text is null").union(spark.createDataFrame([(100, "the word " * 6000, "x", 1), (101, "b " * 4095, "x", 1)], docs.schema))
    rows = packing.packed_documents(some).collect()
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    padded, total = check_packing(rows, texts, 4096, 2)
    assert padded == 0 and total > 12000
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_packing_balances_cost():
    sizes = np.random.default_rng(1).integers(1, 9000, 400)
    out, n = packing.assign(sizes, 4096, 1.0, 1 / 4096)
    cost = Counter()
    for _, _, length, seq, _ in out:
        cost[seq] += length + length**2 / 4096
    used = Counter()
    for _, _, length, seq, _ in out:
        used[seq] += length
    assert sum(used.values()) == sizes.sum() and max(used.values()) == 4096 and len(used) == n
    split = [cost[s] for s in used if used[s] == 4096 and cost[s] < 8192]
    assert max(split) / min(split) < 2


def test_special_tokens_in_texts_are_plain(docs):
    t = packing.WordTable(public_tokenizers.path("word_bpe_49k.json"))
    for x in ODD:
        assert np.frombuffer(t.tokens([x or ""], 2)[0], "<u4").tolist() == [*t.model.encode(x or "", add_special_tokens=False).ids, 2]


def test_chat_reads_back(spark):
    turns = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "\\0\\1<s> <<SYS>>"), (2, 0, "x]<s>\\1\n", "a\\[INST]"), (2, 1, None, None), (2, 2, "assistant", ""),
        (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "<</SYS>>a" * 3000), (4, 0, "user", "tie b"), (4, 0, "user", "tie a"), (None, 0, "user", "lost"), (5, None, "user", "q"), (5, 1, "assistant", "[TURN:x] [/TURN]"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=order)
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert got[c]["loss_text"] == "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert {c: got[c]["valid"] for c in got} == {1: True, 2: False, 3: True, 4: False, None: False, 5: True}
    assert (got[2]["first_bad"], got[4]["first_bad"], got[1]["first_bad"], got[None]["first_bad"]) == (0, 1, None, None)
    for text in ("</s>[INST] ok [/INST]", "<<<s>>", "[TURN:a]"):
        escaped = spark.range(1).select(chat.escape(F.lit(text), chat.Template())).first()[0]
        assert not any(c in escaped for c in chat.Template().controls())
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chats(df.limit(0)).count() == 0


WORD8 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_licenses(text):
    x = (text or "").translate(LOWER)
    w = words(x, WORD8)
    starts, base = [], set()
    for phrase, label in licenses.PHRASES:
        q = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(q)] == q]
        starts += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if base else 0.0
    for line in x.split("\n"):
        block = set(words(line, WORD8))
        for label, template in licenses.TEMPLATES:
            t = set(template.replace(".", " ").split())
            share = len(block & t) / len(t)
            if share >= 0.8 - 1e-12:
                labels.add(label)
                score = max(score, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), round(score, 9)


def test_licenses_equal_brute_force(spark, docs):
    more = ["CC BY cc by\nCC\nby", "all RIGHTS reserved! general public license ccby", "É cc-by 4.0 under licensed, nc", "ſcc by by cc by", "kelvin K released under the mit license", "mit license the under", "released\nunder the mit license", *(t.upper() for _, t in licenses.TEMPLATES), " ".join(licenses.TEMPLATES[7][1].split()[3:]), "z " * 20000 + "all rights reserved"]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 1000)), "doc_id long, text string"))
    got = licenses.scan(all_docs, licenses.word_order(all_docs)).collect()
    told = Counter(repr((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], list(r["base_labels"]), list(r["labels"]), round(r["score"], 9)))) for r in got)
    assert told == Counter(repr((r["doc_id"], brute_licenses(r["text"]))) for r in all_docs.collect())
    plan = licenses.scan(all_docs, licenses.word_order(all_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("ShuffleExchangeExec", "")
    assert licenses.scan(docs.limit(0), licenses.word_order(docs.limit(0))).count() == 0


def brute_runs(text, threshold=0.8):
    """Labels and score of templates, by lines and by every run of words over line ends."""
    x = (text or "").translate(LOWER)
    w, labels, score = words(x, WORD8), set(), 0.0
    for label, template in licenses.TEMPLATES:
        t = template.replace(".", " ").split()
        n = -(-len(t) * 5 // 4)
        blocks = [words(line, WORD8) for line in x.split("\n")] + [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        share = max(len(set(b) & set(t)) / len(set(t)) for b in blocks)
        if share >= threshold - 1e-12:
            labels.add(label)
            score = max(score, share)
    return labels, score


def test_licenses_across_line_ends(spark, docs):
    rng = random.Random(8)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.replace(".", " ").split()}) + [f"other{k}" for k in range(40)]
    wrapped = ["# " + "\n# ".join(textwrap.wrap(t, width, break_long_words=False)) for _, t in licenses.TEMPLATES for width in (12, 30, 60)]
    mixed = []
    for _ in range(120):
        w = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = rng.choice(pool)
            w.insert(rng.randrange(len(w)), rng.choice(pool))
        w = [rng.choice(pool) for _ in range(rng.randrange(40))] + w + [rng.choice(pool) for _ in range(rng.randrange(40))]
        mixed.append("".join(x + rng.choice("    \n") for x in w))
    texts = [*wrapped, *mixed, "released\nunder the mit license", "released\n" + "other " * 9 + "under the mit license", "the mit\n" * 3000]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    order = licenses.word_order(all_docs)
    got = {(r["doc_id"], r["text"]): r for r in licenses.scan(all_docs, order, phrases=(("no such phrase", "none"), ("nor this one", "none")), across=True).join(all_docs, "doc_id").collect()}
    seen = set()
    for r in all_docs.where("doc_id >= 1000").collect():
        labels, score = brute_runs(r["text"])
        mine = got[r["doc_id"], r["text"]]
        assert (set(mine["labels"]), round(mine["score"], 9)) == (labels, round(score, 9)), r["text"]
        seen |= labels
    assert seen == {label for label, _ in licenses.TEMPLATES}
    lines = {r["doc_id"]: r for r in licenses.scan(all_docs, order).collect()}
    for i, (label, _) in enumerate((t for t in licenses.TEMPLATES for _ in range(3)), 1000):
        mine = got[i, texts[i - 1000]]
        assert label in mine["labels"] and mine["score"] == 1.0 and set(lines[i]["labels"]) <= {*mine["labels"], "cc-by", "gpl", "reserved"}
    plan = licenses.scan(all_docs, order, across=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(hit)


def test_quality_counts_equal_brute_force(spark, docs):
    more = ["a b c d e a b c d e", "x\nx\n x\nx", "# * $ %%|\n#", "a b c d e f\n" * 4, "w " * 30000]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 1000)), "doc_id long, text string"))
    got = quality.quality_signals(all_docs, quality.PRIOR).collect()
    names = [x.split()[0] for x in quality.STATS.split(", ")]
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((r["doc_id"], *brute_counts(r["text"])) for r in all_docs.collect())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_signals(docs.limit(0), quality.PRIOR).count() == 0
    assert quality.quality_filter(docs, quality.PRIOR).columns == docs.columns


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 7, 5)
        owner, score, tr = np.repeat(np.arange(5), sizes), rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
        state = quality.viterbi(score, owner, tr)
        for d in range(5):
            s, best = score[owner == d], None
            for path in range(1 << len(s)):
                y = [path >> k & 1 for k in range(len(s))]
                value = sum(s[k] * y[k] for k in range(len(s))) + sum(tr[a, b] for a, b in zip(y, y[1:]))
                best = max(best or (value, y), (value, y))
            assert state[owner == d].tolist() == best[1]


def test_field_learns_held_out_labels(spark):
    rng = np.random.default_rng(6)
    line = lambda mark: " ".join(f"w{x}{mark}" for x in rng.integers(0, 500, 9))
    rows = [(i, "\n".join(line("" if i % 2 else "***") for _ in range(4))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_signals(docs, field).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(40, 80)) >= 39
    assert quality.train(docs, labels.where("quality = 1")) == quality.PRIOR == quality.train(docs, labels.limit(0))


def test_slices_and_hashes():
    texts = [b"ab cd", b"", b"cd ab", b"x" * 50]
    slices = list(tb.slices(texts, limit=8))
    assert [s.n for s in slices] == [2, 1, 1] and hashlib
    s = tb.Slice(texts, 0)
    lo, hi, doc = s.words()
    h = s.hashes(lo, hi)
    assert doc.tolist() == [0, 0, 2, 2, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3
