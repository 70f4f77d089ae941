"""Passages that documents share, exact or fuzzy, by collinear chaining of shared seeds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.chunks import Chunk, ascending, bucket_bits, cells, compiled, inner, mixed, pack, unpack
from stratum.llm.common import Cut, parts, small_batches, texts


@dataclass(frozen=True)
class Params:
    """k: words of a seed. window: consecutive seeds of which the least by hash is kept, so any window + k - 1
    words that two documents share give both a common seed. gap: cost of a chain for each word it leaves out on
    either side. words: least words of a passage. percent: least share of aligned words in it. worth: least words of
    a chain's seeds, those of two; again: times that a document says a seed by which this seed alone will do.
    reach: words beyond a stretch of shared seeds into which a passage may still go on. drop: by how much an extension's score may fall below its best. A fifth of a
    passage's words may be edited, at worst every fifth one, so seeds are of four words and dense."""

    k: int = 4
    window: int = 3
    gap: float = 0.05
    words: int = 50
    percent: int = 80
    worth: int = 8
    again: int = 8
    reach: int = 50
    drop: int = 12
    chunk_chars: int = 5_000_000
    bucket: int = 2_500_000


class Fenwick:
    """Prefix maxima of (score, owner) over places."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def most(self, i: int) -> tuple[float, int]:
        """Over the places before i."""
        out = (float("-inf"), -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(segments: list[tuple[int, int, int]], p: Params) -> list[list[tuple[int, int, int]]]:
    """Chains of segments that ascend in both texts, each segment in one chain at most, the best chain first.

    A segment scores its words and what the best chain before it is worth after the cost of the words left out
    in between. That cost is linear, so a chain's value at its own end is independent of what follows, and the
    best predecessor is a prefix maximum over target places in a Fenwick tree, filled in order of query ends.
    """
    n = len(segments)
    places = sorted({t + w for _, t, w in segments})
    rank = {x: i for i, x in enumerate(places)}
    tree, score, before = Fenwick(len(places)), [0.0] * n, [-1] * n
    ends = sorted(range(n), key=lambda i: segments[i][0] + segments[i][2])
    done = 0
    for i in range(n):
        q, t, w = segments[i]
        # segments that overlap by less than their length may still follow each other, with the overlap cut off
        while done < n and segments[ends[done]][0] + segments[ends[done]][2] <= q:
            j = ends[done]
            a, b, c = segments[j]
            tree.put(rank[b + c], (score[j] + p.gap * (a + c + b + c), j))
            done += 1
        value, j = tree.most(int(np.searchsorted(places, t, "right")))
        gain = value - p.gap * (q + t)
        score[i], before[i] = (w + gain, j) if gain > 0 else (float(w), -1)
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], segments[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(segments[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two lists, by bits: of the words of x, a row of the usual table
    is one number, in which a bit is 0 where the row steps up."""
    if not x or not y:
        return 0
    masks: dict[int, int] = {}
    for i, a in enumerate(x):
        masks[a] = masks.get(a, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for b in y:
        if m := masks.get(b):
            row = (row + (row & m) | row & ~m) & full
    return len(x) - row.bit_count()


def stretch(x: list[int], y: list[int], drop: int) -> tuple[int, int, int]:
    """How far an alignment goes on from the start of x and y: words of x, of y, and aligned ones.

    Greedy: equal words count one, and after a difference the nearest pair of equal words (with an equal word
    after it) within ``drop`` goes on, as long as the score of 1 a match and -1 a word left out stays within
    ``drop`` of its best. The end is where the score was best.
    """
    i = j = same = score = 0
    best = (0, 0, 0, 0)
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, same, score = i + 1, j + 1, same + 1, score + 1
            if score > best[0]:
                best = (score, i, j, same)
            continue
        for d in range(1, drop + 1):
            step = next(((a, d - a) for a in sorted(range(d + 1), key=lambda a: abs(2 * a - d)) if x[i + a : i + a + 2] == y[j + d - a : j + d - a + 2] and x[i + a : i + a + 2]), None)
            if step:
                break
        if not step:
            break
        i, j, score = i + step[0], j + step[1], score - max(step)
        if score < best[0] - drop:
            break
    return best[1:]


def passages(x: list[int], y: list[int], chain: list[tuple[int, int, int]], p: Params) -> list[tuple[int, int, int, int, int]]:
    """(query start, end, target start, end, aligned words) of the passages in a chain, which don't overlap.

    A chain may join passages across words that have nothing in common. So each stretch of its segments, with its
    gaps aligned, is a candidate, as are the extensions of its two ends; the one with most aligned words of which
    ``percent`` are aligned is taken and extended, and what lies before and after it is treated alike.
    """
    out, todo = [], [(chain, (0, 0), (len(x), len(y)))]
    while todo:
        part, (q0, t0), (q1, t1) = todo.pop()
        # ends of each candidate's parts: begins, ends and words aligned up to there, before and after each part
        (q, t, _), (r, u, w) = part[0], part[-1]
        left = stretch(x[q0:q][::-1], y[t0:t][::-1], p.drop)
        right = stretch(x[r + w : q1], y[u + w : t1], p.drop)
        starts, ends, same, at = [], [], 0, None
        if left[2]:
            starts.append((q - left[0], t - left[1], 0))
            ends.append((q, t, left[2]))
            same = left[2]
        for q, t, w in part:
            if at:
                a, b = x[at[0] : q], y[at[1] : t]
                same += common(a, b)
            starts.append((q, t, same))
            same += w
            at = (q + w, t + w)
            ends.append((*at, same))
        if right[2]:
            starts.append((*at, same))
            ends.append((at[0] + right[0], at[1] + right[1], same + right[2]))
        s, e = np.array(starts), np.array(ends)
        whole = e[-1] - s[0]
        best = (int(whole[2]), 0, len(s) - 1) if 100 * whole[2] >= p.percent * max(whole[:2]) else (0, 0, 0)
        for i in range(len(s) if not best[0] else 0):
            d = e[i:] - s[i]
            good = np.where(100 * d[:, 2] >= p.percent * np.maximum(d[:, 0], d[:, 1]), d[:, 2], 0)
            j = int(good.argmax())
            best = max(best, (int(good[j]), -i, j + i))
        _, i, j = best
        (a, c, v), (b, d, z) = starts[-i], ends[j]
        n = z - v
        more = stretch(x[q0:a][::-1], y[t0:c][::-1], p.drop)
        if 100 * (n + more[2]) >= p.percent * max(b - a + more[0], d - c + more[1]):
            a, c, n = a - more[0], c - more[1], n + more[2]
        more = stretch(x[b:q1], y[d:t1], p.drop)
        if 100 * (n + more[2]) >= p.percent * max(b - a + more[0], d - c + more[1]):
            b, d, n = b + more[0], d + more[1], n + more[2]
        if min(b - a, d - c) >= p.words:
            out.append((a, b, c, d, n))
        before = [(q, t, w) for q, t, v in part if (w := min(v, a - q, c - t)) > 0]
        after = [(q + v - w, t + v - w, w) for q, t, v in part if (w := min(v, q + v - b, t + v - d)) > 0]
        todo += [x for x in ((before, (q0, t0), (a, c)), (after, (b, d), (q1, t1))) if x[0]]
    return sorted(out)


def kept(c: Chunk, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place of the seeds that the windows keep, in order of the documents and their words."""
    n = len(c.flat)
    doc = np.repeat(np.arange(len(c.lengths), dtype=np.int32), c.lengths)
    place = np.arange(n, dtype=np.int64) - np.repeat(c.starts, c.lengths)
    room = np.repeat(c.lengths, c.lengths) - place - p.k  # seeds of the document that start after this place
    h = mixed(c.hashes)[c.flat]
    s = np.zeros(n, np.uint64)
    for j in range(p.k):
        s[: n - j] = s[: n - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
    s = mixed(s)
    most = np.uint64(2**64 - 1)
    s[room < 0] = most
    # a window that starts here, or the only one of a short text
    whole = (room >= p.window - 1) | (place == 0) & (room >= 0)
    least, at = s.copy(), np.arange(n)
    for j in range(1, p.window):
        after = np.where(room[: n - j] >= j, s[j:], most)
        lower = np.flatnonzero(after < least[: n - j])
        least[lower] = after[lower]
        at[lower] = lower + j
    chosen = np.zeros(n, bool)
    chosen[at[whole]] = True
    at = np.flatnonzero(chosen)
    # of a seed that follows on itself, as in a word said over and over, one in each stretch
    same = (s[at][1:] == s[at][:-1]) & (doc[at][1:] == doc[at][:-1]) & (place[at][1:] // p.window == place[at][:-1] // p.window)
    at = at[np.append(True, ~same)] if len(at) else at
    return s[at], doc[at], place[at]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by value and, within one, by place; the starts of the groups in it; each key's group."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    return order, first, group


def asked(c_ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(bucket, blob) of a chunk's cells: its distinct keys, the first document and place of each, whether documents of other ids
    have it too, and these documents' ids."""
    if not len(keys):
        return []
    order, first, _ = grouped(keys)
    last = np.append(first[1:], len(keys)) - 1
    ids = c_ids[doc[order]]
    distinct, one, at, many = keys[order][first], doc[order][first], place[order][first], ids[last] != ids[first]
    out = []
    for bucket, a, b in cells(distinct, bits):
        used, index = np.unique(one[a:b], return_inverse=True)
        out.append((bucket, pack(ascending(inner(distinct[a:b], bits)), index.astype(np.uint32), at[a:b].astype(np.uint32), many[a:b].view(np.uint8), used.astype(np.uint32), ascending(c_ids[used]))))
    return out


CELL = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])


def requests(p: Params, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Chunk.load(blob)
                rows = [(i, chunk, x) for i, x in asked(c.ids, *kept(c, p), bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CELL)], CELL.names)

    return run


def firsts(table: pa.Table) -> pa.Table:
    """Answers each cell of a bucket for the keys that documents of two ids or more have: which of the cell's keys
    these are, and the first document, by id, and the place that each has there."""
    chunk = np.array(table.column("chunk").to_pylist())
    got = [unpack(x) for x in table.column("blob").to_pylist()]
    sizes, tables = np.array([len(g[0]) for g in got]), np.array([len(g[4]) for g in got])
    of_chunk, index, ids = np.repeat(chunk, tables), np.concatenate([g[4] for g in got]), np.concatenate([np.cumsum(g[5]) for g in got])
    by = np.lexsort((index, of_chunk, ids))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    holder = np.concatenate([g[1].astype(np.int64) + a for g, a in zip(got, np.cumsum(tables) - tables)])
    place, many = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
    keys = np.concatenate([np.cumsum(g[0]) for g in got])
    del got
    order, first, group = grouped(keys)
    del keys
    id_, ranked = ids[holder[order]], rank[holder[order]]
    shared = (np.maximum.reduceat(id_, first) != np.minimum.reduceat(id_, first)) | (np.maximum.reduceat(many[order], first) > 0)
    # a chunk has a key once, so the least rank of a group is that of one entry
    best = order[ranked == np.repeat(np.minimum.reduceat(ranked, first), np.diff(first, append=len(order)))]
    rows = []
    for k, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        which = np.flatnonzero(shared[group[a : a + n]])
        if len(which):
            entry = best[group[a + which]]
            used, own = np.unique(holder[entry], return_inverse=True)
            rows.append((k, pack(ascending(which.astype(np.uint32)), own.astype(np.uint32), place[entry], of_chunk[used], index[used], ids[used])))
    where = [k for k, _ in rows]
    return pa.table([table.column("bucket").take(pa.array(where, pa.int64())), table.column("chunk").take(pa.array(where, pa.int64())), pa.array([x for _, x in rows], pa.binary())], schema=CELL)


@dataclass
class Found:
    """Keys of a chunk that other documents have too, in order of document and place: the document by its number in the chunk,
    the place, and the first document with the key, by its row in ``holders``, and the place there. holders: chunk,
    number in it and id."""

    doc: np.ndarray
    place: np.ndarray
    key: np.ndarray
    other: np.ndarray
    at: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, doc: np.ndarray, place: np.ndarray, back: pa.Table, bits: int) -> Found:
        order, first, group = grouped(keys)
        start = {bucket: a for bucket, a, _ in cells(keys[order][first], bits)}
        other, at = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        tables, n = [np.zeros((0, 3), np.int64)], 0
        for bucket, blob in zip(back.column("bucket").to_pylist(), back.column("blob").to_pylist()):
            which, own, there, chunk, index, ids = unpack(blob)
            mine = start[bucket] + np.cumsum(which.astype(np.int64))
            other[mine], at[mine] = own.astype(np.int64) + n, there
            tables.append(np.stack([chunk, index.astype(np.int64), ids], 1))
            n += len(chunk)
        holders, same = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
        same = same.reshape(-1)
        live = np.flatnonzero(other[group] >= 0)
        return cls(doc[live].astype(np.int64), place[live].astype(np.int64), keys[live], same[other[group[live]]] if n else np.zeros(0, np.int64), at[group[live]], holders)


def strings(f: Found, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and places of strings of seeds that follow each other in a document.

    A document that has a passage may hold each of its seeds after some other document does, and none of these need
    have the passage. A string of its seeds is had first by a document that has the string. From each seed,
    strings go on until they are as long as the shortest passage. Where all seeds of one have the same first document on one
    diagonal, that document has the string, and none is given.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    key, strange = f.key.copy(), np.zeros(len(f.key), bool)
    live, n = np.arange(max(0, len(key) - 1)), 0
    while len(live):
        n += 1
        live = live[live + n < len(key)]
        end = live + n
        # seeds that share no window with their neighbours are no string
        near = (f.doc[end] == f.doc[live]) & (f.place[end] - f.place[end - 1] <= p.window + p.k)
        live, end = live[near], end[near]
        span = f.place[end] - f.place[live]
        strange[live] |= (f.other[end] != f.other[live]) | (f.at[end] - f.at[live] != span)
        key[live] = mixed(key[live] ^ span.astype(np.uint64)) + f.key[end]
        some = live[strange[live] & (span + p.k >= p.words)]
        out.append((mixed(key[some]), f.doc[some], f.place[some]))
        live = live[span + p.k < p.words]
    return tuple(np.concatenate(x) for x in zip(*out))


def segments(doc: np.ndarray, other: np.ndarray, q: np.ndarray, t: np.ndarray, p: Params) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]]]]:
    """(document, other, chains) of matches, chains of (place, place in other, words)."""
    if not len(doc):
        return
    order = np.lexsort((q, t - q, other, doc))
    doc, other, q, t = doc[order], other[order], q[order], t[order]
    pair = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]))
    # seeds joined along their diagonal where they touch or overlap
    new = pair | np.append(True, (np.diff(t - q) != 0) | (np.diff(q) > p.k))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(q)) - 1
    of = np.cumsum(pair)[a] - 1
    words = q[b] - q[a] + p.k
    start = t[a]
    # single seeds that meet one place of the other over and over: the first stands for all
    rows = np.lexsort((q[a], start, of))
    s, o = start[rows], of[rows]
    head = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))
    group = np.cumsum(head) - 1
    often = np.zeros(len(a), np.int64)
    often[rows] = np.bincount(group)[group]
    first = np.zeros(len(a), bool)
    first[rows] = head
    use = (words > p.k) | first
    sum_ = np.bincount(of, np.where(use, words, 0), minlength=int(of.max(initial=-1)) + 1)
    most = np.zeros(len(sum_), np.int64)
    np.maximum.at(most, of, often)
    good = use & ((sum_[of] >= p.worth) | (most[of] >= p.again))
    a, of, words, often = a[good], of[good], words[good], often[good]
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    for x, y in zip(edges, np.append(edges[1:], len(of))):
        i = a[x]
        rows = sorted(zip(q[a[x:y]].tolist(), t[a[x:y]].tolist(), words[x:y].tolist()))
        loud = {(int(q[k]), int(t[k])) for k, n in zip(a[x:y], often[x:y]) if n >= p.again}
        made = [c for c in (chains(rows, p) if len(rows) > 1 else [rows]) if sum(w for _, _, w in c) >= p.worth or c[0][:2] in loud]
        if made:
            yield int(doc[i]), int(other[i]), made


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(document, start, end) with those that touch made one, in order."""
    out: list[tuple[int, int, int]] = []
    for i, a, b in sorted(spans):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


@dataclass
class Stretches:
    """Runs of shared seeds that share a window with the next: document, first place and end, in order."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, place: np.ndarray, p: Params) -> Stretches:
        if not len(doc):
            return cls(doc, place, place)
        where = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (np.diff(place) > p.window + p.k)))
        return cls(doc[where], place[where], place[np.append(where[1:], len(place)) - 1] + p.k)

    def around(self, doc: int, start: int, end: int) -> tuple[int, int]:
        """Words that go on before and after a chain within the stretches that it starts and ends in."""
        k, z = (int(np.searchsorted(self.flat, doc << 40 | x, "right")) - 1 for x in (start, end))
        left = start - int(self.low[k]) if k >= 0 and self.doc[k] == doc and self.high[k] > start else 0
        right = int(self.high[z]) - end if z >= 0 and self.doc[z] == doc else 0
        return max(0, left), max(0, right)

    @cached_property
    def flat(self) -> np.ndarray:
        return self.doc << 40 | self.low


def chain_rows(doc: np.ndarray, other: np.ndarray, q: np.ndarray, t: np.ndarray, ids: np.ndarray, holders: np.ndarray, s: Stretches, p: Params) -> np.ndarray:
    """The chains of matches, one after the other: document, its words to look at, the other's chunk, number, id and words to look at,
    the number of segments and these."""
    use = ids[doc] != holders[other, 2] if len(doc) else np.zeros(0, bool)
    out = []
    for i, j, made in segments(doc[use], other[use], q[use], t[use], p):
        for c in made:
            (q0, t0, _), (q1, t1, w) = c[0], c[-1]
            left, right = (x + p.reach for x in s.around(i, q0, q1 + w))
            out.append((i, max(0, q0 - left), q1 + w + right, *holders[j].tolist(), max(0, t0 - left - left // 4), t1 + w + right + right // 4, len(c), *(x for y in c for x in y)))
    return np.concatenate([np.array(r, np.int64) for r in out]) if out else np.zeros(0, np.int64)


def found(p: Params, bits: int):
    """Of each chunk a row (bucket -1) with its chains, and where its strings are, and the cells of its strings."""

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        if not own.num_rows or not back.num_rows:
            return CELL.empty_table()
        chunk, c = own.column("chunk")[0].as_py(), Chunk.load(own.column("blob")[0].as_py())
        f = Found.of(*kept(c, p), back, bits)
        key, doc, place = strings(f, p)
        s = Stretches.of(f.doc, f.place, p)
        rows = chain_rows(f.doc, f.other, f.place, f.at, c.ids, f.holders, s, p)
        long = s.high - s.low >= p.words  # a string lies in such a one
        blob = pack(c.ids, rows, key, doc.astype(np.uint32), place.astype(np.uint32), s.doc[long].astype(np.uint32), s.low[long].astype(np.uint32), s.high[long].astype(np.uint32))
        cells_ = [(-1, chunk, blob), *((i, chunk, x) for i, x in asked(c.ids, key, doc, place, bits))]
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*cells_), CELL)], schema=CELL)

    return run


LINK = pa.schema([("chunk", pa.int64()), ("asker", pa.int64()), ("blob", pa.binary())])


def links(p: Params, bits: int):
    """What each chunk wants of itself (asker is -1) and of others, to align its chains: spans of documents, by number,
    start and end. Of itself also the chains."""

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        if not own.num_rows:
            return LINK.empty_table()
        me = own.column("chunk")[0].as_py()
        ids, rows, key, doc, place, *stretches = unpack(own.column("blob")[0].as_py())
        f = Found.of(key, doc.astype(np.int64), place.astype(np.int64), back, bits)
        more = chain_rows(f.doc, f.other, f.place, f.at, ids, f.holders, Stretches(*(x.astype(np.int64) for x in stretches)), p)
        rows = np.concatenate((rows, more))
        if not len(rows):
            return LINK.empty_table()
        mine, wanted = [], {}
        for i, q0, q1, to, number, _, t0, t1, _ in each(rows.tolist()):
            mine.append((i, q0, q1))
            wanted.setdefault(to, []).append((number, t0, t1))
        out = [(to, me, pack(*np.array(united(spans), np.int64).T)) for to, spans in wanted.items()]
        out.append((me, -1, pack(*np.array(united(mine), np.int64).T, rows, ids)))
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out), LINK)], schema=LINK)

    return run


def each(rows: list[int]) -> Iterator[tuple]:
    """The chains of ``chain_rows``, each with its segments last."""
    at = 0
    while at < len(rows):
        end = at + 9 + 3 * rows[at + 8]
        yield (*rows[at : at + 8], [tuple(rows[i : i + 3]) for i in range(at + 9, end, 3)])
        at = end


SERVED = pa.schema([("asker", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])


def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, by 32 bits of their hashes, of the spans that rows (chunk, asker, blob) ask for, each chunk's own words
    (asker -2) first. Nothing but that chunk and one batch is held, however many ask."""
    at, c = None, None
    for b in batches:
        rows = []
        for chunk, asker, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
            if asker == -2:
                at, c = chunk, Chunk.load(blob)
                starts, low = c.starts, (mixed(c.hashes) >> np.uint64(32)).astype(np.uint32)
                continue
            assert at == chunk
            number, a, z, *rest = unpack(blob)
            z = np.minimum(z, c.lengths[number])
            a = np.minimum(a, z)
            flat = np.repeat(starts[number] + a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange(int((z - a).sum()))
            words = low[c.flat[flat]]
            rows.append((chunk if asker == -1 else asker, -1 if asker == -1 else chunk, pack(number, a, z, np.frombuffer(words.tobytes(), np.uint8), *rest)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SERVED)], SERVED.names)


NAMES = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "same", "percent"]
TYPES = [pa.int64()] * 7 + [pa.float64()]


def merged(rows: list[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
    """Passages of one pair that overlap in the document are one, described by its longest alignment."""
    start = end = best = None
    for a, b, c, d, same in [*sorted(rows), (None,) * 5]:
        if best and (a is None or a >= end):
            yield (start, end, *best[1:], 100.0 * best[0][0] / best[0][1])
            best = None
        if a is None:
            return
        worth = ((same, max(b - a, d - c), -a, -c), c, d, same)
        share = lambda x: (x[0][0], x[0][0] / x[0][1], *x[0][2:])
        if not best:
            start, end, best = a, b, worth
        else:
            end = max(end, b)
            best = max(best, worth, key=share)


def aligned(p: Params):
    def run(table: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        own = None
        for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()):
            number, a, z, words, *rest = unpack(blob)
            edges = np.cumsum([0, *(z - a)])
            words = words.view(np.uint32)
            for i, (n, x, y) in enumerate(zip(number.tolist(), a.tolist(), z.tolist())):
                spans.setdefault((chunk, n), []).append((x, y, words[edges[i] : edges[i + 1]]))
            own = rest if chunk == -1 else own

        def part(key: tuple[int, int], place: int) -> tuple[int, int, np.ndarray]:
            """The span of a document that holds a place."""
            return spans[key][bisect_right(spans[key], place, key=lambda s: s[0]) - 1]

        if own is None:
            return pa.table([[]] * len(NAMES), schema=pa.schema(list(zip(NAMES, TYPES))))
        rows, ids = own
        pairs: dict[tuple[int, int, int, int], list] = {}
        for doc, q0, q1, to, n, id_, _, _, chain in each(rows.tolist()):
            (qa, ta, _), (qb, tb, w) = chain[0], chain[-1]
            low, high, x = part((-1, doc), q0)
            q1 = min(q1, high)
            x = x[q0 - low : q1 - low]
            low, high, y = part((to, n), ta)
            left, right = qa - q0, q1 - qb - w
            t0 = max(low, ta - left - left // 4)
            y = y[t0 - low : max(0, min(high, tb + w + right + right // 4) - low)]
            out = pairs.setdefault((doc, to, n, id_), [])
            if len(chain) == 1 and len(x) == len(y) == w and (x == y).all():
                found_ = [(0, w, 0, w, w)] if w >= p.words else []
            else:
                found_ = passages(x.tolist(), y.tolist(), [(q - q0, t - t0, v) for q, t, v in chain], p)
            out += [(s + q0, e + q0, c + t0, d + t0, same) for s, e, c, d, same in found_]
        ready = [(int(ids[doc]), id_, *r) for (doc, _, _, id_), found_ in pairs.items() for r in merged(found_)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*ready) if ready else [[]] * len(NAMES), TYPES)], names=NAMES)

    return run


def shared_passages(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, other_id, start, end, other_start, other_end, same, percent: passages by words, end exclusive.

    1. Documents are compiled into chunks. A chunk asks hash buckets about its distinct seeds, runs of k words kept by
       windows; a bucket answers for those that documents of two ids have, with the first document by id and its place. So
       a seed that a third of all documents have is one entry of each chunk, and never a group of rows.
    2. Each document with a seed is matched to its first document, so a passage of any number of documents gives as many
       matches as it has occurrences; each later document is linked to the first, never all with all. So are strings
       of seeds, up to the length of a passage, where their seeds stand first in different documents: exact passages
       of words + 2 * (window - 1) words or more are linked to a document that has ``words`` words of
       them, whatever pieces earlier documents hold. Shorter ones and fuzzy ones may still be missed where
       earlier documents hold all their shared seeds or strings, but less of the text.
    3. Matches are chained by pair of documents in the chunk of the later one, which asks the other's chunk for the words
       around: over the stretch of shared seeds that the chain lies in, and ``reach`` words beyond. Gaps of a chain are
       aligned exactly and its ends extended; a chain is split where the words it leaves out would bring it under
       ``percent``. A passage counts with ``words`` words on both sides of which ``percent`` are aligned.

    Words are compared by 32 bits of a hash, seeds by their bucket and 40. Null, empty and short texts have no seeds; a null
    doc_id takes no part; each of rows that repeat a doc_id is compared with other ids' rows, and what they find alike
    is given once; repeats within one doc_id are no passage here. An empty table gives no rows; other columns are ignored.
    """
    p = params or Params()
    spark = docs.sparkSession
    small_batches(spark)
    cut = Cut(spark, "passages")
    base = texts(docs).where("doc_id is not null").withColumn("flag", F.lit(False))
    chunks = cut.write(compiled(base, p.chunk_chars), "chunks").select("chunk", "n_words", "blob")
    # one number to the driver; about two seeds of each window + 1 are kept
    bits = bucket_bits(2 * (chunks.agg(F.sum("n_words")).first()[0] or 0) // (p.window + 1), p.bucket)
    cell, link = "bucket long, chunk long, blob binary", "chunk long, asker long, blob binary"
    chunks = chunks.select("chunk", "blob")
    first = cut.write(chunks.mapInArrow(requests(p, bits), cell).groupBy("bucket").applyInArrow(firsts, cell), "firsts", free=True)
    shared = cut.write(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(found(p, bits), cell), "shared", free=True)
    cut.drop("firsts")
    longer = shared.where("bucket >= 0").groupBy("bucket").applyInArrow(firsts, cell)
    wanted = cut.write(shared.where("bucket < 0").groupBy("chunk").cogroup(longer.groupBy("chunk")).applyInArrow(links(p, bits), link), "links", free=True)
    cut.drop("shared")
    rows = wanted.unionByName(chunks.select("chunk", F.lit(-2).cast("long").alias("asker"), "blob"))
    answers = cut.write(rows.repartition(parts(spark), "chunk").sortWithinPartitions("chunk", "asker").mapInArrow(served, "asker long, chunk long, blob binary"), "words", free=True)
    cut.drop("links")
    cut.drop("chunks")
    out = "doc_id long, other_id long, start long, end long, other_start long, other_end long, same long, percent double"
    return answers.groupBy("asker").applyInArrow(aligned(p), out).distinct()
