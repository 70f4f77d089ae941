"""Exact top-k search by inner product over an impact-ordered index, scored a segment at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import parts, pick, small_batches

#: Up to this size of all components, products of a thousand of them fit 64 bits. Vectors beyond are scored with
#: whole numbers of any size.
LARGEST = 1 << 26
#: Wider than any level, so that (dimension, falling level) is one ascending number.
WIDE = 1 << 32


@dataclass(frozen=True)
class Params:
    """k: results of a query. modulus: rows whose vec_id it divides are queries. scale: a component x counts as
    floor(scale * x). step: width of a quantised level of impact. shard: vectors of one index shard at most, about.
    rounds: falls of the impact bound, as shares of the highest impact; the last is 0."""

    k: int = 5
    modulus: int = 50
    scale: int = 256
    step: int = 2
    shard: int = 8192
    rounds: tuple[float, ...] = (0.35, 0.25, 0.18, 0.13, 0.09, 0.06, 0.04, 0.025, 0.012, 0.0)


class Shard:
    """Posting lists of some vectors: for each dimension their ordinals by descending level of |component|.

    A segment is a run of postings of one dimension and level; all of a segment has one quantised impact
    for a query. Exact vectors are kept beside, to rescore possible members.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.step = ids[order], vectors[order], step
        level = -(-np.abs(self.vectors) // step)  # 0 for zeros, which no query needs
        by = np.argsort(-level, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(by.T).astype(np.int32).ravel()
        falling = np.take_along_axis(level, by, 0).T
        self.top = falling[:, 0].copy() if len(ids) else np.zeros(vectors.shape[1], np.int64)
        self.order = (np.arange(vectors.shape[1])[:, None] * WIDE + (WIDE >> 1) - falling).ravel()
        # a component is known up to half a step from its level's middle
        middle = np.sign(self.vectors) * (level * step - (step - 1) / 2.0)
        self.middles = np.ascontiguousarray(np.take_along_axis(middle, by, 0).T).ravel()

    def search(self, query: np.ndarray, own: int, k: int, rounds: tuple[float, ...]) -> list[tuple[int, int]]:
        """(id, score) of the k best, ties to the smaller id, the query's own id left out."""
        n = len(self.ids)
        weight = np.abs(query)
        used = np.flatnonzero(weight)
        total, seen = np.zeros(n), np.zeros(n, np.int64)  # seen: of the query's dimensions
        impact = weight[used] * self.step
        at = used * n
        top = float((impact * self.top[used]).max(initial=0))
        # half a step of each component, and what sums of doubles may be off
        slack = float(weight.sum()) * (self.step - 1) / 2.0 + 1e-12 * top * len(used)
        possible = np.flatnonzero(self.ids != own)
        for share in rounds:
            if len(possible) <= k:
                break
            bound = top * share
            # in each dimension, the segments whose impact is over the bound
            least = (bound // impact).astype(np.int64) + 1
            end = np.maximum(at, np.searchsorted(self.order, used * WIDE + (WIDE >> 1) - least, "right"))
            size = end - at
            if size.any():
                where = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                who = self.postings[where]
                total += np.bincount(who, np.repeat(query[used], size) * self.middles[where], n)
                seen += np.bincount(who, minlength=n)
                at = end
            # what is not yet seen adds or takes at most the bound in each dimension left
            left = (len(used) - seen[possible]) * bound + slack
            low = total[possible] - left
            proof = np.partition(low, len(low) - k)[len(low) - k]  # k rows score so much at least
            possible = possible[total[possible] + left >= proof]
            # so few that whole scores cost less than a fall of the bound
            if len(possible) <= max(4 * k, n // 64):
                break
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(self.ids[possible[i]]), int(scores[i])) for i in best]


def usable(scale: int) -> Column:
    """The scaled components, whole numbers as doubles, or null if the vector takes no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform("embedding", lambda x: x.cast("double") * scale))


def dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors of any lengths as whole numbers, the shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = np.floor(x)
    return out


def product(x: np.ndarray, y: np.ndarray) -> int:
    """The exact inner product of whole numbers of any size; beyond 64 bits, the nearest number of that many."""
    score = sum(int(a) * int(b) for a, b in zip(np.floor(x), np.floor(y)))
    return max(-(1 << 63), min((1 << 63) - 1, score))


def searched(p: Params):
    """(query_id, v, vec_id, score) from rows (shard, asks, vec_id, v): a shard's own vectors first, from which its index is
    made once, then any number of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, large = None, [], None, []

        def build() -> None:
            nonlocal index, large
            large = [(i, v) for i, v in held if np.abs(v).max(initial=0) >= LARGEST]
            small = [(i, v) for i, v in held if np.abs(v).max(initial=0) < LARGEST]
            width = max((len(v) for _, v in small), default=1) or 1
            index = Shard(np.array([i for i, _ in small], np.int64), dense([v for _, v in small], width), p.step)

        def answer(own: int, v: np.ndarray) -> list[tuple[int, int]]:
            if np.abs(v).max(initial=0) >= LARGEST:
                got = [(i, product(v, x)) for i, x in held if i != own]
            else:
                whole = np.zeros(index.vectors.shape[1], np.int64)
                whole[: min(len(v), len(whole))] = np.floor(v)[: len(whole)]
                got = index.search(whole, own, p.k, p.rounds) + [(i, product(v, x)) for i, x in large if i != own]
            return sorted(got, key=lambda r: (-r[1], r[0]))[: p.k]

        for b in batches:
            found = []
            lists = b.column(3)
            values, edges = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            for j, (shard, asks, vec_id) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                v = values[edges[j] : edges[j + 1]]
                if shard != at:
                    at, held, index = shard, [], None
                if not asks:
                    held.append((vec_id, v))
                    continue
                if index is None:
                    build()
                found += [(vec_id, v.tolist(), i, s) for i, s in answer(vec_id, v)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()))], ["query_id", "v", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, params: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all rows but its own.

    The rows are dealt into index shards by a hash of the id; every shard is built once, by one task, and the queries
    stream past it. Within a shard a query takes posting segments by descending quantised impact; after each
    fall of the impact bound it drops the vectors that provably cannot be among the k best, and the few that stay
    possible are rescored exactly. Each shard's k best then meet in one window by query.

    Ties go to the smaller vec_id. Vectors that are null or hold null, NaN or infinite components take no part, nor do
    rows without vec_id. Vectors with components of 2**26 or more after scaling are scored beside the index, with
    whole numbers of any size; a score beyond 64 bits is given as the nearest that fits. Vectors of unequal lengths
    are filled with zeros. Rows that repeat a vec_id are candidates of their own, except to a query of that id;
    a repeated query is asked once for each distinct vector. An empty table gives no rows.
    """
    p = params or Params()
    spark = vectors.sparkSession
    small_batches(spark)
    base = pick(vectors, vec_id="long", embedding="array<double>").select("vec_id", usable(p.scale).alias("v")).where("v is not null")
    # one number comes to the driver
    shards = max(1, -(-base.count() // p.shard))
    index = base.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = base.where(F.col("vec_id") % p.modulus == 0).distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    # shards by number, so that each task gets as many as any other
    n = min(shards, max(parts(spark), spark.sparkContext.defaultParallelism))
    rows = index.unionByName(queries).repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "asks")
    best = rows.mapInArrow(searched(p), "query_id long, v array<double>, vec_id long, score long")
    by = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
