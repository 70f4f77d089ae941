"""The index of byte codes: recall against exact search, and tables that change under it."""

from __future__ import annotations

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from stratum import schemas
from stratum.operators import search
from stratum.plans.engine import Engine
from stratum.plans.store_queries import QUERIES, stored
from stratum.sources import lists
from stratum.sources.store import Store

KEY = ["hash", "file_path"]


def commits(df):
    return stored(df.select(F.col("vec_id").cast("string").alias("hash"), F.lit("").alias("file_path"), F.col("embedding").alias("vector")), schemas.COMMITS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/embeddings.parquet")


def test_recall_by_some_lists_and_bytes(spark, table, tmp_path):
    st = Store(spark, f"{tmp_path}/s")
    st.create("commits", commits(table))
    index = lists.CodeIndex(st, "commits")
    assert index.update() and not index.update()
    about = index.about()
    centres = index.centres(about)
    assert len(centres) == 44
    entries = spark.read.parquet(*(f"{tmp_path}/s/{f}" for f in about["folders"]))
    assert entries.count() == 2 * table.count() and dict(entries.dtypes)["codes"] == "array<tinyint>"
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = list(rows), np.array(list(rows.values()))
    hits = []
    for i in ids[::250]:
        exact = {ids[j] for j in np.argsort(((x - rows[i]) ** 2).sum(1), kind="stable")[:20]}
        got = index.search(rows[i].tolist(), 20, KEY).collect()
        assert got[0].hash == str(i) and [r.score for r in got] == sorted(r.score for r in got)
        assert all(abs(r.score - ((rows[int(r.hash)] - rows[i]) ** 2).sum()) < 1e-9 for r in got)
        hits.append(len(exact & {int(r.hash) for r in got}) / 20)
    assert np.mean(hits) >= 0.9, hits


def test_an_index_follows_its_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).round(3)
    chunks = lambda names, shift=0.0: stored(spark.createDataFrame([(f"f{i}", 1, (x[i] + shift).tolist()) for i in names], "file_path string, start_line int, vector array<double>"), schemas.CHUNKS)
    st = Store(spark, f"{tmp_path}/s", buckets=4)
    st.create("code_files", chunks(range(300)))
    index = lists.CodeIndex(st, "code_files", lists.Params(probes=1.0, refine=10))
    key = ["file_path", "start_line"]
    near = lambda q, k=5: [(r.file_path, round(r.score, 6)) for r in index.search(q.tolist(), k, key).collect()]
    exact = lambda q, k=5: [(r.file_path, round(r.score, 6)) for r in search.knn(st.read("code_files"), q.tolist(), k, key).collect()]
    assert near(x[3]) == exact(x[3])  # without an index
    index.update()
    pinned = lists.CodeIndex(Store(spark, f"{tmp_path}/s", version=st.version()), "code_files", index.p)
    assert near(x[3]) == exact(x[3]) and near(x[3])[0][0] == "f3"
    st.append("code_files", chunks(range(300, 400)))
    assert near(x[350]) == exact(x[350]) and near(x[350])[0][0] == "f350"  # not indexed yet
    folders = len(index.about()["folders"])
    assert index.update() and len(index.about()["folders"]) == folders + 1
    assert near(x[350]) == exact(x[350])
    st.replace_files(spark.createDataFrame([("f3",), ("f350",)], "file_path string"), chunks([3], 9.0))
    for _ in range(2):
        assert near(x[3]) == exact(x[3]) and near(x[350]) == exact(x[350]) and near(x[3] + 9.0)[0] == ("f3", 0.0)
        index.update()
    assert pinned.search(x[3].tolist(), 1, key).first().file_path == "f3"
    st.create("code_files", chunks(range(20)))
    assert near(x[3]) == exact(x[3])
    assert index.update() and index.about()["rows"] == 20 and near(x[3]) == exact(x[3])
    st.vacuum(keep=1, grace=0)
    assert near(x[3]) == exact(x[3])
    st.create("code_files", chunks([]))
    assert index.search(x[3].tolist(), 3, key).count() == 0 and index.search([0.0], 3, key).count() == 0


def test_the_engine_searches_all_three_tables_by_it(spark, table, tmp_path, monkeypatch):
    e = Engine(spark, f"{tmp_path}/s")
    small = table.where("vec_id < 300")
    e.store.create("commits", commits(small))
    e.store.create("code_files", stored(small.select(F.format_string("d%d/f%d", F.col("vec_id") % 5, F.col("vec_id")).alias("file_path"), F.lit(1).alias("start_line"), F.col("embedding").alias("vector")), schemas.CHUNKS))
    e.store.create("pr_data", stored(small.select(F.col("vec_id").alias("pr_number"), F.col("embedding").alias("vector")), schemas.PULLS))
    assert e.index_vectors() == [] and e.index_vectors(least=100) == ["commits", "code_files", "pr_data"] and e.index_vectors(least=100) == []
    asked = []
    real = lists.CodeIndex.search
    monkeypatch.setattr(lists.CodeIndex, "search", lambda self, *a: asked.append(self.name) or real(self, *a))
    q = [float(v) for v in small.where("vec_id = 7").first().embedding]
    assert e.nearest("commits", q, 3, KEY).first().hash == "7" and e.nearest("pr_data", q, 3, ["pr_number"]).first().pr_number == 7
    assert e.nearest_code(q, 3, None).first().file_path == "d2/f7"
    mixed = e.nearest_code(q, 10, "d3").collect()
    assert len(mixed) == 10 and sum(r.file_path.startswith("d3/") for r in mixed) >= 6
    assert asked == ["commits", "pr_data", "code_files", "code_files"]


def test_the_query_finds_most_of_the_nearest(spark):
    got = {r.vec_id for r in QUERIES["ann_some_lists"](spark, DATA).collect()}
    exact = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("vector", F.col("embedding"))
    q = [float(v) for v in exact.where("vec_id = 0").first().embedding]
    assert len(got) == 25 and len(got & {r.vec_id for r in search.knn(exact, q, 25, ["vec_id"]).collect()}) >= 20
