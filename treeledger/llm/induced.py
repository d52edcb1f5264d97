"""Recursive induced suffix sorting with common-prefix values, in numpy batches over disk-backed priority queues.

The text is an array of numbers in which 0 ends each string.  Suffixes are compared up to that 0 only, and common prefixes
are counted up to ``limit``.  As in external SA-IS:

* left-most S positions (LMS) are cut out and their substrings named by sorting; where names aren't unique, the names are
  the text of the next level, which is sorted by the same function, until the names fit the memory budget;
* the common prefix of two names' suffixes, taken from the next level, says where the comparison of their characters may
  begin, so none is compared twice;
* tuples (position, preceding character, common prefix with the tuple before) go from the sorted LMS through a priority
  queue that yields the L suffixes in order, and from those through a second one that yields the S suffixes;
* the common prefix of two induced tuples is one more than the least common prefix between the tuples they come from.

A character's tuples leave the queue in the order in which they were induced.  Characters are taken in groups of
neighbours of which none induces into its own group, so a group is one batch however large the alphabet of names is; a
character that induces itself, or that has more than ``CHUNK`` tuples, is a group alone and is read chunk by chunk.  What
exceeds a queue's memory budget goes to files in the worker's temporary folder, which are read back chunk by chunk and
removed.  What stays in memory: a level's text and types, and some words for each LMS while they are named.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
CHUNK = 1 << 17
#: The recursion ends where so many bytes for each name fit the budget: the names are told apart in memory, by pairs over
#: doubled distances, which takes so much.
NAME_BYTES = 80


def kind(text: np.ndarray) -> np.dtype:
    return np.dtype([("pos", "<u4"), ("before", text.dtype), ("lcp", "u1")])


def cat(parts: list[np.ndarray], of: np.dtype) -> np.ndarray:
    """Tuples one after the other; numpy would match the fields of each part."""
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([np.zeros(0, f"V{of.itemsize}"), *(x.view(f"V{of.itemsize}") for x in parts)]).view(of)


class BucketQueue:
    """Tuples in numbered buckets, in order of arrival; spills its buckets to disk beyond budget bytes."""

    def __init__(self, of: np.dtype, budget: int):
        self.kind, self.budget, self.size = of, budget, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def push(self, bucket: int, tuples: np.ndarray) -> None:
        self.memory.setdefault(bucket, []).append(tuples)
        self.size += tuples.nbytes
        if self.size > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            fd, path = tempfile.mkstemp(prefix="induced-")
            self.file = os.fdopen(fd, "w+b")
            os.unlink(path)  # goes with the process, whatever happens
        self.file.seek(0, os.SEEK_END)
        for bucket, held in self.memory.items():
            x = cat(held, self.kind)
            for lo in range(0, len(x), CHUNK):
                part = x[lo : lo + CHUNK]
                self.spilled.setdefault(bucket, []).append((self.file.tell(), len(part)))
                self.file.write(part.tobytes())
        self.memory.clear()
        self.size = 0

    def load(self, chunk) -> np.ndarray:
        if isinstance(chunk, np.ndarray):
            return chunk
        self.file.seek(chunk[0])
        return np.frombuffer(self.file.read(chunk[1] * self.kind.itemsize), self.kind)

    def read(self, bucket: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """The bucket's chunks, which stay."""
        chunks: list = [*self.spilled.get(bucket, ()), *self.memory.get(bucket, ())]
        for x in reversed(chunks) if backwards else chunks:
            yield self.load(x)[::-1] if backwards else self.load(x)

    def take(self, bucket: int) -> Iterator[np.ndarray]:
        """Takes the bucket's chunks away, those included that arrive meanwhile."""
        while bucket in self.spilled or bucket in self.memory:
            if bucket in self.spilled:  # older than what is in memory, also where it went to disk meanwhile
                for chunk in self.spilled.pop(bucket):
                    yield self.load(chunk)
            else:
                held = self.memory.pop(bucket)
                x = cat(held, self.kind)
                self.size -= x.nbytes
                yield from (x[lo : lo + CHUNK] for lo in range(0, len(x), CHUNK))

    def whole(self, chunks: Iterator[np.ndarray]) -> np.ndarray:
        return cat(list(chunks), self.kind)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class GroupQueue:
    """A priority queue of tuples by group: groups far ahead share a bucket, which is dealt when the first is reached."""

    def __init__(self, text: np.ndarray, group: np.ndarray, budget: int):
        self.text, self.group, self.store = text, group, BucketQueue(kind(text), budget)
        n = int(group.max()) + 1
        self.shift, self.near = 0 if n <= 256 else (n.bit_length() + 1) // 2, -1

    def push(self, tuples: np.ndarray, names: np.ndarray) -> None:
        """names: the tuples' first characters, equal ones side by side."""
        key = self.group[names]
        if self.shift:
            far = key >> self.shift
            key = np.where(far == self.near, key, -1 - far)
        cut = [*_runs(key).tolist(), len(key)]
        for a, e in zip(cut, cut[1:]):
            self.store.push(int(key[a]), tuples[a:e])

    def take(self, group: int) -> Iterator[np.ndarray]:
        if self.shift and group >> self.shift != self.near:
            self.near = group >> self.shift
            for chunk in self.store.take(-1 - self.near):
                names = self.text[chunk["pos"]]
                order = np.argsort(names, kind="stable")
                self.push(chunk[order], names[order])
        return self.store.take(group)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for many ranges, none empty."""
    table, span = [values], 1
    longest = int((hi - lo).max(initial=1))
    while 2 * span <= longest:
        table.append(np.minimum(table[-1][: len(table[-1]) - span], table[-1][span:]))
        span *= 2
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k)])
    return out


class Induction:
    """Sends batches of tuples, in order, to the characters before them."""

    def __init__(self, text: np.ndarray, limit: int, queue: GroupQueue, names: int):
        self.text, self.limit, self.queue = text, limit, queue
        self.turn = 0
        self.last = np.full(names, -1, np.int32)  # the batch that last sent a tuple to each character
        self.tail = np.zeros(names, np.uint8)  # the least common prefix in that batch since then
        self.since = np.full(64, 255, np.uint8)  # the least common prefix in the batches after each one

    def send(self, batch: np.ndarray, allowed: np.ndarray) -> None:
        if not len(batch):
            return
        lcp = batch["lcp"]
        at = np.flatnonzero(allowed)
        if len(at):
            target = batch["before"][at]
            order = np.argsort(target, kind="stable")
            at, target = at[order], target[order]
            first = _runs(target)
            name = target[first]
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[first] = at[first]
            value = least(lcp, lo, at + 1)
            known = self.last[name]
            value[first] = np.minimum(np.minimum.accumulate(lcp)[at[first]], np.minimum(self.tail[name], self.since[known]))
            pos = batch["pos"][at] - 1
            out = np.empty(len(at), batch.dtype)
            out["pos"], out["before"] = pos, self.text[np.maximum(pos, 1) - 1]
            out["before"][pos == 0] = 0
            out["lcp"] = np.minimum(value.astype(np.int64) + 1, self.limit)
            out["lcp"][first[known < 0]] = 0
            self.queue.push(out, target)
            behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.last[name], self.tail[name] = self.turn, behind[at[np.append(first[1:], len(at)) - 1] + 1]
        low = lcp.min()
        self.since[np.searchsorted(self.since[: self.turn], low, "right") : self.turn] = low  # they never fall from batch to batch
        self.turn += 1
        if self.turn == len(self.since):
            self.since = np.concatenate([self.since, np.full(self.turn, 255, np.uint8)])


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; each 0 is."""
    code = np.full(len(text), 1, np.int8)
    code[:-1] = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], 0, -1))
    at = np.where(code >= 0, np.arange(len(text)), len(text))
    return code[np.minimum.accumulate(at[::-1])[::-1]] == 1


def _groups(count: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The group of each character, in the order in which they are taken.  source, target: characters that induce, and
    what they induce, which is never before them."""
    reach, own = np.full(len(count), len(count)), np.zeros(len(count), bool)
    own[source[source == target]] = True
    ahead = source < target
    np.minimum.at(reach, source[ahead], target[ahead])
    out, group, stop, held, alone = [], -1, 0, 0, True
    for c, (n, r, o) in enumerate(zip(count.tolist(), reach.tolist(), own.tolist(), strict=True)):
        if alone or o or c >= stop or held + n > CHUNK:
            group, stop, held, alone = group + 1, r, n, o
        else:
            stop, held = min(stop, r), held + n
        out.append(group)
    return np.array(out)


def _split(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Refines the ranks of live by key (of live, in its order); returns those that still share a rank."""
    order = np.lexsort((key, rank[live]))
    live, key = live[order], key[order]
    old = rank[live]
    edge = np.concatenate([[True], old[1:] != old[:-1]])
    fresh = edge | np.concatenate([[True], key[1:] != key[:-1]])
    n = np.arange(len(live))
    rank[live] = old + np.maximum.accumulate(np.where(fresh, n, 0)) - np.maximum.accumulate(np.where(edge, n, 0))
    single = fresh & np.append(fresh[1:], True)
    return live[~single]


def names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The place of each LMS substring among the distinct ones, from 1; 0 for the ends of strings."""
    wide, bits = (np.uint16, 16) if text.itemsize == 1 else (np.uint32, 32)
    code = (text.astype(wide) << 1) | small
    per = 64 // bits
    length = np.diff(np.append(lms, lms[-1])) + 1
    rank = np.zeros(len(lms), np.int64)
    inner = np.flatnonzero(text[lms] > 0)
    live, column = inner, 0
    while len(live):
        key = np.zeros(len(live), U64)
        for k in range(column, column + per):
            here = code[np.minimum(lms[live] + k, len(code) - 1)].astype(U64)
            key = (key << U64(bits)) | np.where(k < length[live], here, U64(0))
        live = _split(rank, live, key)
        column += per
        live = live[length[live] > column]
    out = np.zeros(len(lms), np.uint32)
    taken = np.zeros(len(lms), bool)
    taken[rank[inner]] = True
    out[inner] = np.cumsum(taken)[rank[inner]]
    return out


def doubled(name: np.ndarray) -> np.ndarray:
    """The rank of each name's suffix among all, by the names behind it; ends (0) come first, by their places."""
    count = np.bincount(name)
    rank = (np.cumsum(count) - count)[name]
    rank[name == 0] = np.arange(count[0])
    live, step = np.flatnonzero((name > 0) & (count[name] > 1)), 1
    while len(live):
        live = _split(rank, live, rank[np.minimum(live + step, len(rank) - 1)])
        step *= 2
    return rank


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, known: np.ndarray | int = 0) -> np.ndarray:
    """The common prefixes of suffixes a and b up to the end of their strings, at most limit.  known: a part of each."""
    out, live = np.zeros(len(a), np.int64) + np.minimum(known, limit), np.arange(len(a))
    while len(live):
        live = live[out[live] < limit]
        x = text[a[live] + out[live]]  # a string's 0 is never passed
        live = live[(x == text[b[live] + out[live]]) & (x != 0)]
        out[live] += 1
    return out


def _sorted_lms(text: np.ndarray, small: np.ndarray, lms: np.ndarray, limit: int, budget: int) -> np.ndarray:
    """Tuples of the LMS suffixes in order; ends of strings come first, by their places."""
    name = names(text, small, lms)
    ends = np.flatnonzero(name == 0)
    top = int(name.max())
    if top + len(ends) == len(lms):  # all are unique
        order, known = np.argsort(name, kind="stable"), 0
    elif len(lms) * NAME_BYTES <= budget:
        order, known = np.argsort(doubled(name)), 0
    else:
        below = [(x["pos"].astype(np.int64), x["lcp"].astype(np.int64)) for x in suffixes(name, limit // 2 + 1, budget)]
        order = np.concatenate([ends, *(x[0] for x in below)])
        shared = np.concatenate([np.zeros(len(ends), np.int64), *(x[1] for x in below)])[1:]
        known = lms[order[1:] + shared] - lms[order[1:]]  # equal names are equal characters, as long as they reach
    out = np.empty(len(order), kind(text))
    at = lms[order]
    out["pos"], out["before"] = at, text[at - 1]
    out["lcp"] = np.concatenate([[0], common(text, at[:-1], at[1:], limit, known)])
    return out


def _turned(x: np.ndarray) -> np.ndarray:
    """Tuples in the other order, each with the common prefix with the one now before it; the first one's is 0."""
    out = x[::-1].copy()
    out["lcp"][1:] = x["lcp"][:0:-1]
    out["lcp"][:1] = 0
    return out


def suffixes(text: np.ndarray, limit: int, budget: int = 64 << 20) -> Iterator[np.ndarray]:
    """Tuples (pos, before, lcp) of all suffixes that don't begin with 0, in order.  text: unsigned, its last number is 0."""
    small = types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return
    seeds = _sorted_lms(text, small, lms, limit, budget)
    count = np.bincount(text)
    top = len(count)
    edges = np.searchsorted(text[seeds["pos"]], np.arange(top + 1))
    at = np.flatnonzero(~small[:-1])
    rising = _groups(count, text[at + 1].astype(np.int64), text[at].astype(np.int64))
    at = np.flatnonzero(small[:-1] & (text[:-1] > 0))
    falling = _groups(count[::-1], top - 1 - text[at + 1].astype(np.int64), top - 1 - text[at].astype(np.int64))[::-1]
    del small, lms, at
    ups, downs = GroupQueue(text, rising, budget), GroupQueue(text, falling, budget)
    large, little = BucketQueue(kind(text), budget), BucketQueue(kind(text), budget)

    def joined(a: np.ndarray, b: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A group's tuples by character, a character's of a before those of b; their characters; which are of b."""
        both, second = cat([a, b], a.dtype), np.arange(len(a) + len(b)) >= len(a)
        char = text[both["pos"]]
        order = np.argsort(top - 1 - char.astype(np.int64) if backwards else char, kind="stable")
        both, second, char = both[order], second[order], char[order]
        meet = np.flatnonzero(second[1:] & ~second[:-1] & (char[1:] == char[:-1])) + 1
        both["lcp"][meet] = common(text, both["pos"][meet - 1].astype(np.int64), both["pos"][meet].astype(np.int64), limit)
        return both, char, second

    def keep(batch: np.ndarray, char: np.ndarray) -> None:
        group = falling[char]
        cut = [*_runs(group).tolist(), len(group)]
        for a, e in zip(cut, cut[1:]):
            large.push(int(group[a]), batch[a:e])

    def meeting(last: int, batch: np.ndarray) -> int:
        return 0 if last < 0 else int(common(text, np.array([last]), batch["pos"][:1].astype(np.int64), limit)[0])

    try:
        sender = Induction(text, limit, ups, top)
        cut = [*_runs(rising).tolist(), top]
        for g, (c, e) in enumerate(zip(cut, cut[1:])):
            if e - c > 1:
                batch, char, second = joined(ups.store.whole(ups.take(g)), seeds[edges[c] : edges[e]], False)
                keep(batch[~second], char[~second])
                sender.send(batch, second | (batch["before"] >= char))
                continue
            last = -1
            for batch in ups.take(g):
                large.push(int(falling[c]), batch)
                sender.send(batch, batch["before"] >= c)
                last = int(batch["pos"][-1])
            for lo in range(edges[c], edges[e], CHUNK):
                batch = seeds[lo : min(lo + CHUNK, edges[e])].copy()
                if lo == edges[c]:
                    batch["lcp"][0] = meeting(last, batch)
                sender.send(batch, np.ones(len(batch), bool))
        ups.store.close()
        del seeds
        sender = Induction(text, limit, downs, top)
        cut = [*_runs(falling).tolist(), top]
        spans = list(zip(cut, cut[1:]))[::-1]
        for g, (c, e) in enumerate(spans):
            if e - c > 1:
                batch, char, second = joined(downs.store.whole(downs.take(g)), _turned(large.whole(large.read(g))), True)
                little.push(g, batch[~second])
                sender.send(batch, (batch["before"] > 0) & ((batch["before"] < char) | (~second & (batch["before"] == char))))
                continue
            last = -1
            for batch in downs.take(g):
                little.push(g, batch)
                sender.send(batch, (batch["before"] <= c) & (batch["before"] > 0))
                last = int(batch["pos"][-1])
            carry = -1  # read backwards, a tuple's common prefix is with the one that follows
            for batch in large.read(g, backwards=True):
                turned = batch.copy()
                turned["lcp"][1:] = batch["lcp"][:-1]
                turned["lcp"][0] = meeting(last, batch) if carry < 0 else carry
                carry = int(batch["lcp"][-1])
                sender.send(turned, (batch["before"] < c) & (batch["before"] > 0))
        for g, (c, e) in reversed(list(enumerate(spans))):
            if e - c > 1:
                batch, _, _ = joined(large.whole(large.read(g)), _turned(little.whole(little.read(g))), False)
                if len(batch):
                    yield batch
                continue
            last = -1
            for batch in large.read(g):
                yield batch
                last = int(batch["pos"][-1])
            carry = -1
            for batch in little.read(g, backwards=True):
                turned = batch.copy()
                turned["lcp"][1:] = batch["lcp"][:-1]
                turned["lcp"][0] = meeting(last, batch) if carry < 0 else carry
                carry = int(batch["lcp"][-1])
                yield turned
    finally:
        for q in (ups.store, downs.store, large, little):
            q.close()
