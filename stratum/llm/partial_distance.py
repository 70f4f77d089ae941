"""Clusters around centroids, found by partial distances: dimensions that vary most first, far centroids abandoned early."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches
from stratum.llm.vectors import exact, long_or_none, matrix, vectors

#: Beyond this a component's distances are no longs.
LARGEST = float(1 << 60)


@dataclass(frozen=True)
class Params:
    """dimensions: of a vector that takes part. scale: of components before they become whole numbers. clusters, rounds: of
    centroids and of their replacement. seed: of the choice of first centroids. step: dimensions after which centroids
    are abandoned."""

    dimensions: int = 64
    scale: int = 256
    clusters: int = 40
    rounds: int = 5
    seed: str = "2:"
    step: int = 8


def kept(table: DataFrame, p: Params) -> DataFrame:
    """vec_id and the whole numbers of vectors of that many components."""
    rows = vectors(table).where((F.size("vector") == p.dimensions) & ~F.exists("vector", lambda x: F.abs(x) * p.scale >= LARGEST))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * p.scale).cast("long")))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of several, and its squared distance.

    Differences are summed up over ``step`` dimensions at a time, in that order. After the first ones, the centroid that is nearest
    so far is finished, as the best one yet; each other is abandoned once it is strictly above that.
    """
    x, c = x[:, order], centroids[:, order]
    n, size = len(x), x.shape[1]
    part = x[:, None, :step] - c[None, :, :step]
    sums = (part * part).sum(2)
    first = sums.argmin(1)
    whole = x - c[first]
    best = (whole * whole).sum(1)
    row, at = np.nonzero((sums <= best[:, None]).astype(bool))
    sums = sums[row, at]
    for start in range(step, size, step):
        part = x[row, start : start + step] - c[at, start : start + step]
        sums = sums + (part * part).sum(1)
        stay = (sums <= best[row]).astype(bool)
        row, at, sums = row[stay], at[stay], sums[stay]
    # of each row, the one of least distance and number comes first; the finished one is always among them
    by = sorted(range(len(row)), key=lambda k: (row[k], sums[k], at[k])) if sums.dtype == object else np.lexsort((at, sums, row))
    row, at, sums = row[by], at[by], sums[by]
    leads = np.searchsorted(row, np.arange(n))
    return at[leads], sums[leads]


def spread(rows: DataFrame, p: Params) -> np.ndarray:
    """Dimensions by falling variance over all vectors; it only decides how soon centroids are abandoned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, np.zeros(p.dimensions), np.zeros(p.dimensions)
        for batch in batches:
            x = matrix(batch.column(1)).astype(float)
            n, a, b = n + len(x), a + x.sum(0), b + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(p.dimensions), pa.int32()), pa.array([float(n)] * p.dimensions), pa.array(a), pa.array(b)], ["dimension", "n", "a", "b"])

    sums = rows.mapInArrow(run, "dimension int, n double, a double, b double").groupBy("dimension").agg(*(F.sum(c).alias(c) for c in "nab"))
    variance = {r.dimension: r.b - r.a * r.a / r.n if r.n else 0.0 for r in sums.collect()}  # a row a dimension
    return np.array(sorted(range(p.dimensions), key=lambda d: (-variance.get(d, 0.0), d)))


def chosen(rows: DataFrame, p: Params) -> np.ndarray:
    """The first centroids: the vectors of the smallest hashes of their ids, those of one id by their components."""
    key = F.sha2(F.concat(F.lit(p.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(p.clusters).collect()  # ``clusters`` rows
    return exact(np.array([r.vector for r in first], np.int64).reshape(len(first), p.dimensions))


def replaced(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, p: Params) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean, exactly; one without vectors stays. A task sums up its own vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = exact(matrix(batch.column(1)))
            own, _ = nearest(x, centroids, order, p.step) if len(x) else ([], None)
            for k in np.unique(own):
                here = x[own == k]
                n[int(k)] = n.get(int(k), 0) + len(here)
                sums[int(k)] = [a + int(b) for a, b in zip(sums.get(int(k), [0] * p.dimensions), here.sum(0))]
        flat = [(k, d, n[k], v) for k, of in sums.items() for d, v in enumerate(of)]
        columns = list(zip(*flat)) or [[]] * 4
        high, low = zip(*(divmod(v, 1 << 40) for v in columns[3])) if flat else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["cluster", "dimension", "n", "high", "low"])

    parts = rows.mapInArrow(run, "cluster int, dimension int, n long, high long, low long")
    now = centroids.astype(object)
    for r in parts.groupBy("cluster", "dimension").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect():  # a row a component of a centroid
        now[r.cluster, r.dimension] = ((r.high << 40) + r.low) // r.n
    return exact(now)


def centroids_of(rows: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after all rounds, and the order of dimensions."""
    order = spread(rows, p)
    centroids = chosen(rows, p)
    for _ in range(p.rounds if len(centroids) else 0):
        centroids = replaced(rows, centroids, order, p)
    return centroids, order


def clusters(table: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors never move: a round is a narrow pass over the table, in which each task sums up its vectors by centroid, and a sum over
    tasks of as many numbers as all centroids have components. That, and the centroids, are all that the driver sees. A lost
    executor costs its tasks' share of one pass.

    Vectors that are null, hold null, nan or infinity, or have another number of components take no part, and neither do
    those with a component of 2**60 or more once scaled, to which no distance is a long; distances and sums beyond a long are null.
    Of repeated rows each is a row of its own, alike. A null vec_id takes part, hashed as the empty text. With fewer vectors
    than ``clusters`` there are fewer centroids; an empty table gives no rows. Further columns are ignored, whatever their names.
    """
    p = params or Params()
    small_batches(table.sparkSession)
    rows = kept(table, p)
    centroids, order = centroids_of(rows, p)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))

    def assigned(x: np.ndarray) -> tuple[list[int], list[int | None]]:
        own, far = nearest(x, centroids, order, p.step)
        return own.tolist(), [int(v) for v in far]

    def inertias(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            if len(batch):
                for k, v in zip(*assigned(exact(matrix(batch.column(1))))):
                    sums[k] = sums.get(k, 0) + v
        high, low = zip(*(divmod(v, 1 << 40) for v in sums.values())) if sums else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([str(v) for v in high]), pa.array(low, pa.int64())], ["cluster", "high", "low"])

    by_cluster = rows.mapInArrow(inertias, "cluster int, high string, low long").groupBy("cluster").agg(F.sum(F.col("high").cast("decimal(28,0)")).alias("high"), F.sum("low").alias("low"))
    inertia = {r.cluster: (int(r.high) << 40) + r.low for r in by_cluster.collect()}  # a row a centroid
    total = long_or_none(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, far = assigned(exact(matrix(batch.column(1))))
            columns = [pa.array(own, pa.int32()), pa.array(map(long_or_none, far), pa.int64()), pa.array([long_or_none(inertia[k]) for k in own], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([digests[k] for k in own])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def oracle(p: Params | None = None) -> str:
    """The same rows in DuckDB's SQL: every centroid's whole distance from every vector, in each round."""
    p = p or Params()
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda r: f"a{r} as materialized (select row, vec_id, v, min_by(k, (d, k)) as k, min(d) as d from (select row, vec_id, v, k, {far} as d from kept, c{r}) group by all)"
    steps = []
    for r in range(p.rounds):
        mean = f"select k, list((s - ((s % n) + n) % n) // n order by j) as c from (select k, j, sum(v[j])::hugeint as s, count(*)::hugeint as n from a{r}, range(1, {p.dimensions} + 1) t(j) group by k, j) group by k"
        steps.append(f"{near(r)},\nm{r} as ({mean}),\nc{r + 1} as materialized (select c{r}.k, coalesce(m{r}.c::bigint[], c{r}.c) as c from c{r} left join m{r} on m{r}.k = c{r}.k)")
    return f"""
with kept as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {p.dimensions} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as k, v as c from (select sha256('{p.seed}' || coalesce(vec_id::varchar, '')) as h, v from kept order by h, v limit {p.clusters})),
{(',' + chr(10)).join(steps)},
{near(p.rounds)},
sums as (select k, sum(d) as i from a{p.rounds} group by k)
select vec_id, k::integer as cluster, d::bigint as distance, i::bigint as cluster_inertia, (select sum(i) from sums)::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{p.rounds} join sums using (k) join c{p.rounds} using (k)"""
