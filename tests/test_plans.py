"""What the plans of hot operators must and must not have."""

from __future__ import annotations

from compare import DATA

from stratum.operators import graph, search
from stratum.plans import inputs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_is_a_top_k_with_a_pushed_filter(spark):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("vector", F.array(F.col("n_chars").cast("float")))
    p = plan(search.knn(e.select("source", "doc_id", "vector"), [1.0], 5, ["doc_id"], F.col("source").startswith("src1")))
    assert "TakeOrderedAndProject" in p and "StringStartsWith(source,src1)" in p and "Exchange" not in p and "Python" not in p and "text" not in p.split("ReadSchema")[1]


def test_co_change_joins_by_commit_without_nested_loops(spark):
    p = plan(graph.co_change(inputs.visits(spark, DATA, "day"), inputs.now()))
    assert "NestedLoop" not in p and "Cartesian" not in p and "TakeOrderedAndProject" in p and "Python" not in p


def test_windows_need_no_shuffle(spark):
    from stratum.operators import chunk

    assert "Exchange" not in plan(chunk.windows(inputs.files(spark, DATA), 8, 2, summaries=True))


def test_degrees_are_summed_partially(spark):
    p = plan(graph.degrees(inputs.edges(spark, DATA)))
    assert p.count("HashAggregate") >= 2 and p.count("Exchange") == 1


def test_labels_of_a_file_are_ranked_before_they_are_gathered(spark):
    from pyspark.sql import functions as F

    from stratum.operators import prompt
    from stratum.plans.store_queries import stored
    from stratum.schemas import EDGES

    e = stored(inputs.edges(spark, DATA).withColumn("edge_type", F.lit("call")), EDGES).withColumn("ord", F.struct("caller_file", "line", "callee_name"))
    p = plan(prompt.structure(e.select(F.col("caller_file").alias("file_path")).distinct(), e, inputs.now()))
    assert p.count("WindowGroupLimit") >= 2 and "NestedLoop" not in p
