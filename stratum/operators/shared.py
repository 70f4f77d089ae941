"""What two blocks of classes of files share, summed up in place, and the heaviest pairs among it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

PAIRS = "file_a string, file_b string, weight double, raw_count long"
#: A block of classes as a row: for each its id, its first two members and its number of commits; the commits, in order, with their weights,
#: and the places among these of each class's, as compressed steps.
BLOCKS = "block int, ids array<long>, first array<string>, second array<string>, n array<long>, commits array<long>, weights array<double>, places binary"
CLASS_PAIRS = "one long, two long, file_a string, file_b string, weight double, raw_count long"
OTHERS = "id long, other string, weight double"


def sums(one: pd.DataFrame, two: pd.DataFrame, step: int = 1024, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Weights and counts of the commits that each class of the one and each of the two share."""
    flat = lambda d: (np.concatenate(list(d.commits)), np.repeat(np.arange(len(d)), d.n), np.concatenate(list(d.weights)))
    (ca, ra, wa), (cb, rb, _) = flat(one), flat(two)
    both, shape = np.intersect1d(ca, cb), (len(one), len(two))
    weight, count = np.zeros(shape), np.zeros(shape)
    if not len(both):
        return weight, count

    def placed(c: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        """Those of common commits, in order of these and by their place."""
        at = np.searchsorted(both, c)
        hit = both[np.minimum(at, len(both) - 1)] == c
        order = np.argsort(at[hit], kind="stable")
        return [x[hit][order] for x in (at, *more)]

    ca, ra, wa = placed(ca, ra, wa)
    cb, rb = placed(cb, rb)
    first = np.searchsorted(cb, np.arange(len(both) + 1))
    n = np.diff(first)[ca]
    if n.sum() * 200 < len(both) * weight.size:  # few classes have each commit
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]), most):
            k = np.arange(lo, min(lo + most, int(ends[-1])))
            a = np.searchsorted(ends, k, "right")
            cell = ra[a] * len(two) + rb[first[ca[a]] + k - (ends[a] - n[a])]
            weight += np.bincount(cell, wa[a], weight.size).reshape(shape)
            count += np.bincount(cell, minlength=weight.size).reshape(shape)
        return weight, count
    for lo in range(0, len(both), step):
        x, y = np.zeros((len(one), step)), np.zeros((len(two), step))
        a, b = (slice(*np.searchsorted(c, (lo, lo + step))) for c in (ca, cb))
        x[ra[a], ca[a] - lo] = wa[a]
        y[rb[b], cb[b] - lo] = 1
        weight += x @ y.T
        x[ra[a], ca[a] - lo] = 1
        count += x @ y.T
    return weight, count


def cell(pdf: pd.DataFrame, min_shared: int, min_rate: float) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, bool]:
    """The two blocks of a cell, hundredths of weights, -1 where a pair doesn't count, counts, and whether it is one block with itself."""
    one = pdf[pdf.side == 0].reset_index(drop=True)
    own = bool(pdf.i.iloc[0] == pdf.j.iloc[0])
    two = one if own else pdf[pdf.side == 1].reset_index(drop=True)
    weight, count = sums(one, two)
    good = (count >= min_shared) & (count / np.minimum.outer(one.n.to_numpy(), two.n.to_numpy()) >= min_rate)
    if own:
        np.fill_diagonal(good, np.diag(good) & (one.members.str.len() > 1).to_numpy())
    return one, two, np.where(good, np.floor(weight * 100 + 0.5), -1).astype(np.int64), count, own


def ranks(*names: pd.Series) -> list[np.ndarray]:
    """Places of names among all of them."""
    _, at = np.unique(np.concatenate([n.to_numpy(dtype=object) for n in names]), return_inverse=True)
    return np.split(at, np.cumsum([len(n) for n in names])[:-1])


def in_order(one: list[str], two: list[str] | None) -> Iterator[tuple[str, str]]:
    """Pairs of members of two classes, or of one, by the lesser name, then the greater."""
    side = {x: 0 for x in one} | {x: 1 for x in two or ()}
    names = sorted(side)
    for k, x in enumerate(names):
        yield from ((x, y) for y in names[k + 1 :] if two is None or side[x] != side[y])


def places(count: int) -> type:
    return np.uint16 if count <= 1 << 16 else np.uint32


def packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of a block (block, id, first, second, n, commits, weights) as one row."""
    own = np.concatenate(list(pdf.commits))
    commits, of = np.unique(own, return_index=True)
    steps = np.diff(np.searchsorted(commits, own), prepend=0).astype(places(len(commits)))  # those back to the next class's first wrap around
    row = [pdf.block.iloc[0], pdf.id, pdf["first"], pdf.second, pdf.n, commits, np.concatenate(list(pdf.weights))[of], zlib.compress(steps.tobytes(), 1)]
    return pd.DataFrame([[list(x) if isinstance(x, (pd.Series, np.ndarray)) else x for x in row]], columns=[x.split()[0] for x in BLOCKS.split(", ")])


@dataclass
class Side:
    """Classes by their place, and at: the places of the commits of each, from start to the next one's, among some that are asked for."""

    ids: np.ndarray
    first: pd.Series
    second: pd.Series
    n: np.ndarray
    start: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, row: pd.Series, common: np.ndarray) -> Side:
        """A packed block, and of its commits those at the places ``common``."""
        kind = places(len(row.commits))
        at = np.cumsum(np.frombuffer(zlib.decompress(row.places), kind), dtype=kind)
        new = np.full(len(row.commits), -1)
        new[common] = np.arange(len(common))
        at, n = new[at], np.asarray(row.n)
        hit = at >= 0
        ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(n)])]
        return cls(np.asarray(row.ids), pd.Series(row["first"], dtype=object), pd.Series(row.second, dtype=object), n, ends, at[hit])

    def matrix(self, lo: int, hi: int, first: int, last: int) -> np.ndarray:
        """A row for each class from lo, a column for each commit from first: 1 where it is the class's."""
        c = self.at[self.start[lo] : self.start[hi]]
        r = np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))
        hit = (c >= first) & (c < last)
        out = np.zeros((hi - lo, last - first), np.float32)
        out[r[hit], c[hit] - first] = 1
        return out

    def table(self, lo: int, hi: int, weights: np.ndarray) -> pd.DataFrame:
        """What ``sums`` takes, of the classes from lo."""
        own = [self.at[x:y] for x, y in zip(self.start[lo:hi], self.start[lo + 1 : hi + 1])]
        return pd.DataFrame({"commits": pd.Series(own, dtype=object), "weights": pd.Series([weights[c] for c in own], dtype=object), "n": np.diff(self.start[lo : hi + 1])})


class Heaviest:
    """The ``top`` pairs of classes of two sides, tile by tile: rows of the one with all of the other.

    Most pairs are only bounded. What they share is counted by a product in single precision, three classes of less than 256 commits to a
    number, each in a byte of its own: a pair weighs no more than its count times the greatest weight. Where that lets too many through, a
    product of weights bounds them, whose relative error is no greater than that of as many sums as a class has commits. Those that may be
    among the heaviest by what is known so far are summed up in double precision.
    """

    def __init__(self, one: Side, two: Side, own: bool, weights: np.ndarray, top: int, min_shared: int, min_rate: float, floor: int = 0, step: int = 1024, many: int = 8192) -> None:
        self.one, self.two, self.own, self.weights, self.top, self.min_shared, self.min_rate = one, two, own, weights, top, min_shared, min_rate
        self.steps = [(x, min(x + step, len(weights))) for x in range(0, len(weights), step)]
        self.many = max(many, 4 * top)
        self.error = (min(one.n.max(), two.n.max()) + 2) * 2.0**-23
        first, last, second = ranks(one.first, two.first, one.second.where(one.second.notna(), one.first))
        self.names = first, last, second
        self.found, self.floor = np.zeros((4, 0), np.int64), floor  # rows, columns, hundredths, counts; no pair of less than floor hundredths is wanted
        hits = np.bincount(one.at, minlength=len(weights)) @ np.bincount(two.at, minlength=len(weights))
        self.few = hits * 200 < len(weights) * len(one.n) * len(two.n)  # few classes have each commit
        self.whole = two.matrix(0, len(two.n), *self.steps[0]) if len(self.steps) == 1 and not self.few else None
        self.threes = self.packed() if self.whole is not None and min(one.n.max(), two.n.max()) < 256 else None
        self.loose = 0  # tiles of which counts let too many through

    def packed(self) -> np.ndarray:
        three = np.zeros((-(-len(self.whole) // 3) * 3, self.whole.shape[1]), np.float32)
        three[: len(self.whole)] = self.whole
        return three[::3] + 256 * three[1::3] + 65536 * three[2::3]

    def other(self, first: int, last: int) -> np.ndarray:
        return self.two.matrix(0, len(self.two.n), first, last) if self.whole is None else self.whole

    def product(self, lo: int, hi: int, weighted: bool) -> np.ndarray:
        out = np.zeros((hi - lo, len(self.two.n)), np.float32)
        for x, y in self.steps:
            m = self.one.matrix(lo, hi, x, y)
            out += (m * self.weights[x:y].astype(np.float32) if weighted else m) @ self.other(x, y).T
        return out

    def good(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether pairs count; a is of the one's rows, b of the other's."""
        out = (count >= self.min_shared) & (count / np.minimum(self.one.n[a], self.two.n[b]) >= self.min_rate)
        return out & ((a < b) | ((a == b) & self.one.second.notna().to_numpy()[a])) if self.own else out

    def cut(self) -> float:
        """No pair that is wanted has a product of less."""
        return (self.floor - 0.5) / 100 * (1 - self.error) * (1 - 1e-6) if self.floor > 0 else -1.0

    def counted(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs that may be wanted by their counts, or None where these don't say or leave too many."""
        need = max(self.min_shared, int(np.ceil((self.floor - 0.5) / 100 / self.weights.max() - 1e-6))) if self.floor > 0 and self.weights.max() > 0 else 0
        if self.threes is None or need < 1 or self.loose > 2:
            return None
        if need > 255:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = (self.one.matrix(lo, hi, *self.steps[0]) @ self.threes.T).astype("<i4").view(np.uint8)
        may = np.flatnonzero(count >= np.uint8(need))
        if len(may) > self.many:
            self.loose += 1
            return None
        a, b = np.divmod(may, count.shape[1])
        return a, b // 4 * 3 + b % 4

    def tile(self, lo: int, hi: int) -> None:
        if not self.few and (pairs := self.counted(lo, hi)) is not None:
            return self.summed(lo, hi, *pairs)
        rows, columns = np.arange(lo, hi)[:, None], np.arange(len(self.two.n))[None, :]
        if self.few:
            return self.whole_tile(lo, hi, np.ones((hi - lo, len(self.two.n)), bool))
        bound = self.product(lo, hi, True)
        may = bound >= np.float32(self.cut())
        if np.count_nonzero(may) > self.many:
            may &= self.good(rows, columns, self.product(lo, hi, False).astype(np.float64))
            left = bound[may]
            if len(left) > self.top:
                least = float(np.partition(left, -self.top)[-self.top])  # as many pairs weigh that at least, but for the error
                self.floor = max(self.floor, int(np.floor(least * (1 - self.error) * (1 - 1e-6) * 100 + 0.5)))
                may &= bound >= np.float32(self.cut())
            if np.count_nonzero(may) > self.many:
                return self.whole_tile(lo, hi, may)
        return self.summed(lo, hi, *np.nonzero(may))

    def summed(self, lo: int, hi: int, a: np.ndarray, b: np.ndarray) -> None:
        if len(a) == 0:
            return
        weight, count = np.zeros(len(a)), np.zeros(len(a))
        for x, y in self.steps:
            m, other = self.one.matrix(lo, hi, x, y), self.other(x, y)
            for k in range(0, len(a), 2048):
                part = slice(k, k + 2048)
                both = (m[a[part]] * other[b[part]]).astype(np.float64)
                weight[part] += both @ self.weights[x:y]
                count[part] += both.sum(axis=1)
        self.take(a + lo, b, weight, count)

    def whole_tile(self, lo: int, hi: int, may: np.ndarray) -> None:
        weight, count = sums(self.one.table(lo, hi, self.weights), self.two.table(0, len(self.two.n), self.weights))
        a, b = np.nonzero(may & (count >= self.min_shared))
        self.take(a + lo, b, weight[a, b], count[a, b])

    def take(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray, count: np.ndarray) -> None:
        """Those of the pairs that are among the heaviest so far."""
        w = np.floor(weight * 100 + 0.5).astype(np.int64)
        keep = self.good(a, b, count) & (w >= self.floor)
        new = np.array([a[keep], b[keep], w[keep], count[keep].astype(np.int64)])
        found = np.concatenate([self.found, new], axis=1)
        if found.shape[1] > self.top:
            found = found[:, found[2] >= np.partition(found[2], -self.top)[-self.top]]
        x, y = self.pair_names(found)
        self.found = found[:, np.lexsort((np.maximum(x, y), np.minimum(x, y), -found[2]))[: self.top]]
        if self.found.shape[1] == self.top:
            self.floor = max(self.floor, int(self.found[2, -1]))

    def pair_names(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by name of the first pair of files of each pair of classes."""
        first, last, second = self.names
        a, b = found[:2]
        return first[a], np.where((a == b) & self.own, second[a], last[b])


def heaviest_pairs(pdf: pd.DataFrame, top: int, min_shared: int, min_rate: float, floor: int = 0, rows: int = 512) -> pd.DataFrame:
    """The ``top`` pairs of classes of a cell (one packed block, or two), of ``floor`` hundredths at least, by weight and the names of
    their first pair of files."""
    own = len(pdf) == 1
    rows_of = [r for _, r in pdf.sort_values("block").iterrows()]
    common, *at = np.intersect1d(rows_of[0].commits, rows_of[-1].commits, assume_unique=True, return_indices=True)
    one = Side.of(rows_of[0], at[0])
    two = one if own else Side.of(rows_of[1], at[1])
    best = Heaviest(one, two, own, np.asarray(rows_of[0].weights)[at[0]], top, min_shared, min_rate, floor)
    lo = 0
    while lo < len(one.n):  # a narrow tile first, as nothing is known before it
        hi = min(len(one.n), lo + (rows if lo else max(1, rows // 8)))
        best.tile(lo, hi)
        lo = hi
    a, b, w, count = best.found
    f, g = one.first.to_numpy()[a], np.where((a == b) & own, one.second.to_numpy()[a], two.first.to_numpy()[b])
    return pd.DataFrame({"one": one.ids[a], "two": two.ids[b], "file_a": np.minimum(f, g), "file_b": np.maximum(f, g), "weight": w / 100, "raw_count": count})


def members_pairs(batches: Iterator[pd.DataFrame], top: int) -> Iterator[pd.DataFrame]:
    """The first ``top`` pairs of files of each pair of classes (members, others: null for a class with itself, weight, raw_count)."""
    for pdf in batches:
        for r in pdf.itertuples():
            pairs = in_order(list(r.members), None if r.others is None else list(r.others))
            found = [(p, q, r.weight, r.raw_count) for _, (p, q) in zip(range(top), pairs)]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in PAIRS.split(", ")])


def heaviest_others(pdf: pd.DataFrame, per: int, min_shared: int, min_rate: float) -> pd.DataFrame:
    """For each class of a cell the ``per`` heaviest files, by weight and name, its own members among them."""
    one, two, weight, _, own = cell(pdf, min_shared, min_rate)
    out = []
    for own_side, other, w in [(one, two, weight)] + ([] if own else [(two, one, weight.T)]):
        (rank,) = ranks(other.members.str[0])
        key = np.where(w >= 0, w * len(other) + (len(other) - 1 - rank)[None, :], -1)
        k = min(per, len(other))
        best = np.argpartition(key, -k, axis=1)[:, -k:]
        for r, id_ in enumerate(own_side.id):
            found = [(-int(w[r, c]), m) for c in best[r] if w[r, c] >= 0 for m in other.members[c][:per]]
            out += [(id_, m, -x / 100) for x, m in sorted(found)[:per]]
    return pd.DataFrame(out, columns=[x.split()[0] for x in OTHERS.split(", ")])
