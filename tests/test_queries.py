"""Every query that SQL can express against DuckDB on whole tables; the others against plain Python."""

from __future__ import annotations

import random

import pytest
from compare import DATA, same

from stratum import catalog
from stratum.operators import budget

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert same(QUERIES[name](spark, DATA), SQL[name]) > 0


#: Answers that depend on trained centres; test_lists.py measures them against exact ones.
TRAINED = {"ann_some_lists"}


def test_every_query_has_sql():
    assert set(QUERIES) - TRAINED == set(SQL)


def filled(rows, code_budget, commit_budget, commit_first, used=0):
    """Places by a plain loop: taken results, seeds, then the rest."""
    place, code, commit = {}, used, 0
    for r in rows:
        if r["taken"]:
            place[r["rank"]] = len(place)
    seeds = [next((r for r in rows if r["type"] == t and not (t == "code" and r["expanded"])), None) for t in (("commit", "code") if commit_first else ("code", "commit"))]
    for r in seeds:
        if r and r["rank"] not in place:
            place[r["rank"]] = len(place)
            code, commit = (code + r["cost"], commit) if r["type"] == "code" else (code, commit + r["cost"])
    for r in rows:
        if r["rank"] in place or (r["type"] == "code" and r["expanded"]):
            continue
        total, c, whole = code + commit, r["cost"], code_budget + commit_budget
        own_full = code + c > code_budget if r["type"] == "code" else commit + c > commit_budget
        favoured = (r["type"] == "code") != commit_first
        if own_full and (not favoured or total + c > whole):
            continue
        code, commit = (code + c, commit) if r["type"] == "code" else (code, commit + c)
        if total + c > whole and place:
            break
        place[r["rank"]] = len(place)
    return place


@pytest.mark.parametrize("seed", range(6))
def test_fill_matches_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        kind = rng.choice(["code", "code", "commit", "pr"])
        expanded = kind == "code" and rng.random() < 0.3
        rows.append({"rank": i + 1, "type": kind, "cost": rng.randint(50, 900), "expanded": expanded, "taken": expanded and rng.random() < 0.5})
    code, commit, first = rng.randint(500, 5000), rng.randint(500, 5000), seed % 2 == 0
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "rank int, type string, cost int, expanded boolean, taken boolean")
    got = {r["rank"]: r.place for r in budget.fill(df, code, commit, first, 100).collect() if r.place is not None}
    assert got == filled(rows, code, commit, first, 100)


def test_expansions_skip_and_go_on(spark):
    df = spark.createDataFrame([("a", 1, 300), ("b", 2, 900), ("c", 3, 200), ("d", 4, 100), ("e", 5, 90)], "file_path string, place int, cost int")
    kept = {r.file_path for r in budget.expansions(df, 1000).where("kept").collect()}
    assert kept == {"a", "c"}  # 400 and 300 of 850; 200 more is over


def test_expansions_take_whole_tables(spark):
    rng = random.Random(4)
    sizes = [rng.choice([3, 400, 900, 3000, 30_000]) for _ in range(3000)]
    df = spark.createDataFrame([(f"f{i}", i, c) for i, c in enumerate(sizes)], "file_path string, place int, cost int")
    used, expected = 0, set()
    for i, c in enumerate(sizes):
        if used + c + budget.HEADER <= 9000 * budget.SHARE:
            used += c + budget.HEADER
            expected.add(f"f{i}")
    assert {r.file_path for r in budget.expansions(df, 9000).where("kept").collect()} == expected
    files = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r.place: r.kept for r in QUERIES["expansion_budget"](spark, DATA).collect()}
    used = 0
    for r in files:
        fits = used + len(r.text) + budget.HEADER <= 60_000 * budget.SHARE
        used += (len(r.text) + budget.HEADER) * fits
        assert got.pop(r.doc_id) == fits
    assert not got and len(files) > 60
