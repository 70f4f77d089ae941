"""Plans and spreads that hold when tables grow."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from compare import DATA
from pyspark.sql import functions as F

from stratum.operators import chunk, graph, shared
from stratum.plans import inputs
from stratum.plans.file_queries import SPANS, SYMBOLS
from stratum.plans.graph_queries import CALLS, FUNCTIONS, IMPORTS, KNOWN


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_out_of_short_rows_is_not_broadcast(spark):
    read = lambda x: x.df(spark, DATA)
    targets = graph.import_targets(read(IMPORTS), read(KNOWN))
    inside = graph.enclosing(read(CALLS).withColumnRenamed("caller_file", "file_path"), read(FUNCTIONS))
    tags = chunk.tagged(read(SPANS), read(SYMBOLS))
    callees = graph.resolved(read(CALLS), read(FUNCTIONS), targets, least=10**9)  # no name is frequent
    for df in (targets, inside, tags, callees):
        assert "Broadcast" not in plan(df)


def test_rows_of_short_keys_are_dealt_over_tasks(spark):
    keys = spark.range(50_000).withColumnRenamed("id", "k").coalesce(1)
    out = inputs.dealt(keys, "k")
    assert out.rdd.getNumPartitions() == 3 and out.count() == 50_000
    assert max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < inputs.DEALT


def test_imports_mean_the_first_file_of_their_stem(spark):
    files = spark.createDataFrame([(x,) for x in ("a/b.ts", "a/b.js", "a/b.ts", "a/b", "a/c/index.js", "a/c/index.ts", "a/d.ts.ts", "a/d.ts", None)], "file_path string")
    asked = [("a/x.ts", "./b"), ("a/x.ts", "./b.ts"), ("a/y/x.ts", "../c"), ("a/x.ts", "./d"), ("a/x.ts", "./d.ts"), ("a/x.ts", "b"), ("a/x.ts", None), (None, "./b"), ("a/x.ts", "./none"), ("a/x.ts", "./b")]
    got = graph.import_targets(spark.createDataFrame(asked, "file_path string, source string"), files).collect()
    want = ["a/b", "a/b.ts", "a/c/index.ts", "a/d.ts", "a/d.ts", None, None, None, None, "a/b"]
    assert sorted(map(str, got)) == sorted(f"Row(file_path={f!r}, source={s!r}, target={t!r})" for (f, s), t in zip(asked, want))


@pytest.mark.parametrize("seed", range(3))
def test_co_changes_match_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "BLOCK", 9)
    rng = random.Random(seed)
    of = {f"f{i:02}": {h for h in range(30) if rng.random() < 0.4} for i in range(25)}
    of |= {f"g{i:02}": of[rng.choice(["f01", "f02", "f03"])] for i in range(20)} | {f"h{i}": set(range(100 * i + 100, 100 * i + 104)) for i in range(2)}
    rows = [(f"c{h:03}", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=h), f) for f, own in of.items() for h in own for _ in range(rng.choice((1, 1, 2)))]
    commits = spark.createDataFrame([*rows, ("c000", rows[0][1], "")], "hash string, date timestamp, file_path string")
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    pairs = []
    for a in sorted(of):
        for b in sorted(of):
            both = of[a] & of[b]
            if a < b and len(both) >= 3 and len(both) / min(len(of[a]), len(of[b])) >= 0.5:
                pairs.append((-round(sum(2 ** (-(365 - h) / 365) for h in both), 2), a, b, len(both), f"c{max(both):03}", f"c{min(both):03}"))
    pairs.sort()
    for top in (7, 60, 5000):
        got = [(-r.weight, r.file_a, r.file_b, r.raw_count, r.latest_hash, r.earliest_hash) for r in graph.co_change(commits, now, top=top).collect()]
        assert got == pairs[:top]
    of_file = {f: sorted((w, b if a == f else a) for w, a, b, *_ in pairs if f in (a, b))[:5] for f in of}
    want = sorted((f, o, -w, i + 1) for f, found in of_file.items() for i, (w, o) in enumerate(found))
    assert sorted(tuple(r) for r in graph.heaviest(commits, now).collect()) == want and len(want) > 100


@pytest.mark.parametrize("commits", [12, 40_000])
def test_shared_commits_of_few_and_of_many_classes(commits):
    rng = np.random.default_rng(5)
    table = lambda n: pd.DataFrame({"commits": (own := [np.sort(rng.choice(commits, 9, replace=False)) for _ in range(n)]), "weights": [1 / (2.0 + x) for x in own], "n": 9})
    one, two = table(40), table(30)
    weight, count = shared.sums(one, two, most=50)
    for i, a in enumerate(one.commits):
        for j, b in enumerate(two.commits):
            both = np.intersect1d(a, b)
            assert count[i, j] == len(both) and abs(weight[i, j] - (1 / (2.0 + both)).sum()) < 1e-9


def packed_block(block: int, own: list, weights: np.ndarray, twins: int = 0) -> pd.DataFrame:
    """Classes of commits ``own``, every ``twins``-th of two members."""
    ids = np.arange(len(own)) + 10_000 * block
    names = [f"u{i * 7919 % 100_003}" for i in ids]
    second = [n + "b" if twins and i % twins == 0 else None for n, i in zip(names, ids)]
    return shared.packed(pd.DataFrame({"block": block, "id": ids, "first": names, "second": second, "n": [len(x) for x in own], "commits": own, "weights": [weights[x] for x in own]}))


def plain_heaviest(one: pd.DataFrame, own: list, two: pd.DataFrame, others: list, weights: np.ndarray, top: int, rate: float, least: int) -> list:
    a, b = (np.zeros((len(x), len(weights))) for x in (own, others))
    for m, x in ((a, own), (b, others)):
        for i, c in enumerate(x):
            m[i, c] = 1
    count, weight = a @ b.T, np.floor((a * weights) @ b.T * 100 + 0.5)
    good = (count >= least) & (count / np.minimum.outer(a.sum(1), b.sum(1)) >= rate)
    (f, s, g), same = (one["first"][0], one.second[0], two["first"][0]), one is two
    found = [(-weight[i, j] / 100, *sorted((f[i], s[i] if same and i == j else g[j])), count[i, j]) for i, j in zip(*np.nonzero(good)) if not same or i < j or (i == j and s[i])]
    return sorted(found)[:top]


@pytest.mark.parametrize(("classes", "commits", "share", "alike", "rate", "top"), [
    (700, 720, 0.09, False, 0.1, 50),  # counts bound it, three to a number
    (700, 720, 0.09, True, 0.1, 50),  # very many of the same weight
    (300, 720, 0.6, False, 0.5, 50),  # more commits than a byte counts
    (300, 2500, 0.05, False, 0.1, 20),  # more commits than are taken at once
    (300, 60_000, 0.0002, False, 0.01, 20),  # few classes have each commit
    (300, 90, 0.1, False, 0.9, 400),  # few pairs count
])
def test_the_heaviest_of_a_cell_match_plain_sums(classes, commits, share, alike, rate, top):
    rng, least = np.random.default_rng(3), 1 if commits == 60_000 else 3
    weights = np.full(commits, 0.5) if alike else 2.0 ** -(np.arange(commits) / commits * (3 if commits > 720 else 0.1))
    draw = lambda: [np.sort(rng.choice(commits, max(3, rng.binomial(commits, share)), replace=False)) for _ in range(classes)]
    sides = [draw(), draw()]
    one, two = (packed_block(i, x, weights, 11) for i, x in enumerate(sides))
    for many in (one, pd.concat([two, one])):
        other, others = (one, sides[0]) if len(many) == 1 else (two, sides[1])
        want = plain_heaviest(one, sides[0], other, others, weights, top, rate, least)
        for floor in (0, round(-want[len(want) // 2][0] * 100)):
            got = shared.heaviest_pairs(many, top, least, rate, floor, 64)
            assert [(-r.weight, r.file_a, r.file_b, r.raw_count) for r in got.itertuples()] == [r for r in want if -r[0] * 100 >= floor - 0.5] and len(got)


def test_most_pairs_of_unlike_files_are_only_bounded(monkeypatch):
    monkeypatch.setattr(shared, "sums", None)  # would sum up all pairs in double precision
    summed = []
    monkeypatch.setattr(shared.Heaviest, "take", lambda self, a, *more, f=shared.Heaviest.take: (summed.append(len(a)), f(self, a, *more)))
    rng = np.random.default_rng(4)
    own = [[np.flatnonzero(rng.random(720) < 0.09) for _ in range(3000)] for _ in range(2)]
    weights = 2.0 ** -(np.arange(720) / 24 / 365)
    one, two = (packed_block(i, x, weights) for i, x in enumerate(own))
    assert len(shared.heaviest_pairs(pd.concat([one, two]), 500, 3, 0.1)) == 500 and sum(summed) < 9_000_000 / 100
    assert len(one.places[0]) < 1.5 * one.n[0][0] * 3000  # and a commit of a class takes about a byte where blocks are shuffled


def test_co_changes_of_several_packed_blocks_match_one(spark, monkeypatch):
    rng = random.Random(7)
    commits = spark.createDataFrame([(f"c{h:02}", datetime.datetime(2024, 1, 1 + h // 2), f"f{i:03}") for i in range(120) for h in range(40) if rng.random() < 0.3], "hash string, date timestamp, file_path string")
    found = []
    for block in (1000, 4):
        monkeypatch.setattr(graph, "BLOCK", block)
        found.append([tuple(r) for r in graph.co_change(commits, F.lit("2024-12-31 00:00:00").cast("timestamp"), min_rate=0.3, top=70).collect()])
    assert found[0] == found[1] and len(found[0]) == 70
    assert graph.co_change(commits.where("false"), F.current_timestamp()).collect() == []


def test_blocks_go_by_classes_whatever_parts_are_made(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 50)
    kind, deal = type(spark.range(0)), type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *cols: deal(self, 40, *cols))
    commits = spark.range(1200).select(F.concat(F.lit("c"), F.col("id") % 12 + F.floor(F.col("id") / 12)).alias("hash"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("date"), F.format_string("f%03d", F.floor(F.col("id") / 12)).alias("file_path"))
    classes = graph.classes_of(graph.histories(commits, F.current_timestamp(), 365.0, 3), 5)
    assert sorted(r["count"] for r in classes.groupBy("block").count().collect())[0] > 30 and classes.select("block").distinct().count() == 2


def test_co_changes_of_files_in_the_same_commits_are_never_all_paired(spark):
    files = 30_000  # of the same 30 commits: 450 million pairs
    commits = spark.range(files * 30).select(F.concat(F.lit("c"), F.col("id") % 30).alias("hash"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("date"), F.format_string("f%06d", F.floor(F.col("id") / 30)).alias("file_path"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = graph.co_change(commits, now).collect()
    assert [(r.file_a, r.file_b, r.weight) for r in got] == [("f000000", f"f{i:06}", 30.0) for i in range(1, 501)]
    best = graph.heaviest(commits, now)
    assert best.count() == files * 5
    assert [r.other for r in best.where("file_path = 'f000002'").orderBy("rank").collect()] == ["f000000", "f000001", "f000003", "f000004", "f000005"]


def test_a_closure_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = spark.range(40).select(F.lit("a.ts").alias("caller_file"), F.concat(F.lit("n"), "id").alias("caller_name"), F.lit("a.ts").alias("callee_file"), F.concat(F.lit("n"), F.col("id") + 10).alias("callee_name"))
    found = graph.closure(edges.mapInPandas(count, edges.schema), spark.createDataFrame([("a.ts", "n3")], "file string, name string"))
    assert sorted(r.name for r in found.collect()) == ["n13", "n23", "n3", "n33", "n43"] and read.value == 40


def test_commits_are_shuffled_once_by_orders_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(inputs, "ITEMS", 1000)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        commits = inputs.commits(spark, DATA)
        assert plan(commits).count("Exchange") == 2  # one of line items, one of orders
        assert commits.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
