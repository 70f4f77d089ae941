"""The training-data queries by name, with DuckDB SQL where SQL can express them. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import backoff_lm, bbit, chaining, fertility, impact_index, mil, mixing, packing, partial_distance, pii, prefix_bpe, secrets, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"))


def op2_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(table(spark, sf_dir, "embeddings"))


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(table(spark, sf_dir, "documents"))


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "text", "source", "lang", "n_chars"])
    return mixed.select("doc_id", "source", "lang", "n_chars", "copy", F.round("rate", 9).alias("rate"), "place", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents")).withColumn("findings", F.to_json("findings"))


def op10_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_distance.clusters(table(spark, sf_dir, "embeddings"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = prefix_bpe.encode(table(spark, sf_dir, "documents"), back=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (select vec_id, generate_subscripts(v, 1) as d, unnest(v) as x from whole),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from flat q join flat c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by all),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from scored)
select query_id, "rank", vec_id, score from ranked where "rank" <= 5
"""

#: Every pair of documents that share a shingle, with whole counts; the components by recursion over links.
OP8_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from words),
sizes as (select doc_id, len(s) as n from sets),
flat as (select doc_id, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways as (select a, b from links union select b, a from links),
reach(node, other) as (select a, b from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
least as (select node, min(other) as m from reach group by node)
select doc_id, cast(n as bigint) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, least(doc_id, coalesce(m, doc_id)) = doc_id as kept
from sizes left join least on node = doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fertility, op2_impact_topk, op3_backoff_lm, op4_collinear_chains, op5_bootstrapped_pii, op6_poisson_mix, op7_balanced_packing, op8_bbit_minhash, op9_secret_ownership, op10_attention_mil, op11_partial_distance, op12_prefix_bpe, op13_tiled_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_impact_topk": OP2_SQL, "op6_poisson_mix": mixing.oracle(), "op8_bbit_minhash": OP8_SQL, "op11_partial_distance": partial_distance.oracle()}
