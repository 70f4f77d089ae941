"""Nearest neighbours by squared distance: exact, scoped, filtered, quantised with refinement, and by lists."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNROLLED = 128


def distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal vector.

    The terms of up to UNROLLED dimensions are written out: a plain sum is compiled with the stage, while a
    higher-order function is interpreted row by row. Beyond that the code would take longer to compile than it
    saves on all but the largest tables, and a stage may grow too large to be compiled at all.
    """
    q = [float(x) for x in query]
    if len(q) <= UNROLLED:
        # A balanced tree keeps the expression shallow.
        terms = [(F.get(vector, F.lit(i)).cast("double") - F.lit(x)) * (F.get(vector, F.lit(i)).cast("double") - F.lit(x)) for i, x in enumerate(q)]
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0] if terms else F.lit(0.0)
    return F.aggregate(F.zip_with(vector, F.lit(q), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def knn(table: DataFrame, query: Sequence[float], k: int, key: Sequence[str], where: Column | None = None, vector: str = "vector") -> DataFrame:
    """The k rows nearest to ``query`` among those that pass ``where``, with score, ties by ``key``.

    The filter reaches the scan, the vector is dropped once the distance is known, and the order and limit become
    one top-k per task and a merge. Null vectors and those of another length take no part.
    """
    rows = (table if where is None else table.where(where)).where(F.size(vector) == len(query))
    return rows.withColumn("score", distance(F.col(vector), query)).drop(vector).orderBy("score", *key).limit(k)


def scoped_and_global(table: DataFrame, query: Sequence[float], k: int, folder: str | None, key: Sequence[str], path: str = "file_path", vector: str = "vector") -> DataFrame:
    """Three fifths of k from within a folder, or its parent if that has none, the rest from everywhere.

    A row may come from both, as the two parts aren't compared.
    """
    if not folder:
        return knn(table, query, k, key, vector=vector)
    share = math.ceil(0.6 * k)
    for prefix in (folder, folder.rstrip("/").rpartition("/")[0]):
        near = F.col(path).startswith(prefix)
        if prefix and not table.where(near).isEmpty():
            return knn(table, query, share, key, near, vector).unionByName(knn(table, query, k - share, key, vector=vector))
    return knn(table, query, k, key, vector=vector)


def with_symbols(table: DataFrame) -> Column:
    """Chunks that define or export something."""
    return (F.size("functions") + F.size("classes") + F.size("exports")) > 0


def quantised(vector: Column, scale: float = 127.0) -> Column:
    """Components as whole numbers of a byte."""
    return F.transform(vector, lambda x: F.round(x * scale).cast("tinyint"))


def quantised_knn(table: DataFrame, query: Sequence[float], k: int, key: Sequence[str], refine: int = 3, scale: float = 127.0, codes: str = "codes", vector: str = "vector") -> DataFrame:
    """Top ``refine`` times k by the distance of codes, then the top k of those by that of whole vectors."""
    coarse = table.withColumn("rough", distance(F.col(codes), [round(float(x) * scale) for x in query])).orderBy("rough", *key).limit(refine * k)
    return coarse.withColumn("score", distance(F.col(vector), query)).drop(vector, codes, "rough").orderBy("score", *key).limit(k)


def assign_lists(table: DataFrame, centres: Sequence[Sequence[float]], vector: str = "vector") -> DataFrame:
    """Adds ``list_id``, the nearest of a few centres; tables written with it as partition column are pruned by it."""
    ranked = F.array(*(F.struct(distance(F.col(vector), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    return table.withColumn("list_id", F.array_min(ranked)["i"])


def probe(table: DataFrame, query: Sequence[float], k: int, key: Sequence[str], centres: Sequence[Sequence[float]], probes: int, vector: str = "vector") -> DataFrame:
    """Top k over the lists of the ``probes`` nearest centres; all of them give the exact answer."""
    order = sorted(range(len(centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centres[i], query)))
    return knn(table, query, k, key, F.col("list_id").isin(order[:probes]), vector)


#: Rows from which on an index is worth its while.
INDEXED = 10_000


def train_centres(table: DataFrame, lists: int, sample: int = 20_000, rounds: int = 10, vector: str = "vector") -> np.ndarray:
    """Centres of so many lists, by k-means over at most ``sample`` vectors, the first by hash, on the driver."""
    rows = table.where(F.size(vector) > 0).select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = Counter(len(r[0]) for r in rows).most_common(1)[0][0]  # vectors of another length are in no search
    x = np.array([list(r[0]) for r in rows if len(r[0]) == width], float)
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:lists]]
    for _ in range(rounds):
        own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class ListIndex:
    """A table dealt into lists of near vectors, which are folders of its files: a search reads only the lists whose centres are
    nearest to the question. All rows are indexed; the centres are trained on a bounded sample and lie beside the table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r.list_id)
        self.schema = T.StructType.fromJson(json.loads(rows[0].schema)).add("list_id", T.IntegerType())
        self.centres = np.array([list(r.centre) for r in rows[1:]], float)

    @classmethod
    def build(cls, table: DataFrame, path: str, lists: int | None = None, sample: int = 20_000, vector: str = "vector") -> ListIndex:
        spark, path = table.sparkSession, path.rstrip("/")
        lists = lists or max(1, math.isqrt(table.count()) // 2)
        centres = train_centres(table, lists, sample, vector=vector)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            out = np.zeros(len(v), int)
            fits = [i for i, x in enumerate(v) if x is not None and len(x) == centres.shape[1]]
            if fits:
                x = np.array([v.iloc[i] for i in fits], float)
                out[fits] = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
            return pd.Series(out)

        table.withColumn("list_id", nearest(F.col(vector))).repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        about = [(-1, None, table.schema.json()), *((i, c.tolist(), None) for i, c in enumerate(centres))]
        spark.createDataFrame(about, "list_id int, centre array<double>, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path)

    def search(self, query: Sequence[float], k: int, key: Sequence[str], probes: int, vector: str = "vector") -> DataFrame:
        order = ((self.centres - np.array(query, float)) ** 2).sum(1).argsort(kind="stable")[:probes].tolist() if len(self.centres) else [0]
        return knn(self.spark.read.schema(self.schema).parquet(f"{self.path}/rows"), query, k, key, F.col("list_id").isin(order), vector).drop("list_id")
