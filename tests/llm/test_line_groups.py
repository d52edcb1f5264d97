"""Verification of large groups of lines."""

import random

from treeledger.llm import jaccard, lines


def test_hundreds_of_lines_are_verified_by_one_product(monkeypatch):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [words[k % 9 * 40 : k % 9 * 40 + 30] for k in range(600)]
    texts = [" ".join([*t, *draw.choices(words, k=k % 4)]) for k, t in enumerate(texts)]
    group = [(k + 1, t.encode()) for k, t in enumerate(dict.fromkeys(texts))]
    assert len(group) > 256

    sets = {k: {t[i : i + lines.WIDTH] for i in range(len(t) - lines.WIDTH + 1)} for k, t in group}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = sorted((k, find(k)) for k in sets if find(k) != k)
    assert want

    def no_tree(*_):
        raise AssertionError("compared line by line in a prefix tree")

    monkeypatch.setattr(jaccard, "links_in_group", no_tree)
    assert sorted(lines.verified([group], 80)) == want
