"""Queries over vectors, questions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions import intent
from stratum.operators import budget, expand, rerank, search
from stratum.plans import inputs
from stratum.plans.inputs import CHUNKS_SQL, NOW_SQL, QUESTIONS, distance_sql

K = 25


def slim(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "file_path", F.round("score", 6).alias("score"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    top = search.knn(e, inputs.question(spark, sf_dir), K, ["vec_id"])
    return top.select("vec_id", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy("score", "vec_id")).alias("rank"))


def knn_prefix_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slim(search.knn(inputs.chunks(spark, sf_dir), inputs.question(spark, sf_dir), K, ["vec_id"], F.col("file_path").startswith("src1")))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slim(search.knn(inputs.chunks(spark, sf_dir), inputs.question(spark, sf_dir), K, ["vec_id"], F.col("content").contains("|")))


def knn_scoped_global_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slim(search.scoped_and_global(inputs.chunks(spark, sf_dir), inputs.question(spark, sf_dir), 20, "src2/d1", ["vec_id"]))


def knn_quantised_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of whole numbers find three times k candidates, whole vectors order them."""
    e = inputs.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector").withColumn("codes", search.quantised(F.col("vector")))
    return search.quantised_knn(e, inputs.question(spark, sf_dir), K, ["vec_id"], refine=3).select("vec_id", F.round("score", 6).alias("score"))


def ann_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by nearest centre; probing all of them is exact."""
    e = inputs.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    centres = [inputs.question(spark, sf_dir, i) for i in (1, 7, 20, 33)]
    return search.probe(search.assign_lists(e, centres), inputs.question(spark, sf_dir), K, ["vec_id"], centres, 4).select("vec_id", F.round("score", 6).alias("score"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best code, commit and pull request rows as one table of candidates with dates."""
    q = inputs.question(spark, sf_dir)
    chunks = inputs.chunks(spark, sf_dir)
    dated = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), F.col("o_orderdate").alias("date"))
    kinds = {"code": (0, 20), "commit": (1, 10), "pr": (2, 5)}
    parts = [search.knn(chunks.select("vec_id", "file_path", "content", "vector"), q, k, ["vec_id"], F.col("vec_id") % 3 == r).withColumn("type", F.lit(t)) for t, (r, k) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(dated, "vec_id", "left")


STREAMS_SQL = f"""(select s.*, o_orderdate as date from (
  select * from (select vec_id, file_path, content, {distance_sql()} as score, 'code' as type from {CHUNKS_SQL} where vec_id % 3 = 0 order by score, vec_id limit 20)
  union all select * from (select vec_id, file_path, content, {distance_sql()} as score, 'commit' as type from {CHUNKS_SQL} where vec_id % 3 = 1 order by score, vec_id limit 10)
  union all select * from (select vec_id, file_path, content, {distance_sql()} as score, 'pr' as type from {CHUNKS_SQL} where vec_id % 3 = 2 order by score, vec_id limit 5)) s
  left join orders on o_orderkey = vec_id)"""
YEARS_SQL = "((epoch_ms({a}) - epoch_ms({b}))::double / 31557600000.0)"


def reranked(spark: SparkSession, sf_dir: str, anchor: str | None) -> DataFrame:
    at = F.lit(anchor).cast("timestamp")
    out = rerank.rerank(streams(spark, sf_dir), inputs.now(), F.lit(0.8), F.lit(1.5), F.lit(0.9), F.lit(0.4), at)
    return rerank.ranked(out, "type", "vec_id").select("vec_id", "type", F.round("score", 6).alias("score"), "rank")


def union_streams_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, None)


def rerank_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, "1998-07-01 00:00:00")


def rerank_sql(factor: str) -> str:
    return f"""with w as (select vec_id, type, score / case type when 'commit' then 0.8 when 'pr' then 0.9 else 1.5 end * case when type = 'code' or date is null then 1.0 else {factor} end as score from {STREAMS_SQL})
select vec_id, type, round(score, 6) as score, cast(row_number() over (order by score, type, vec_id) as integer) as rank from w"""


def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = streams(spark, sf_dir)
    c = rerank.boost(c, "overview", rerank.documentation(F.col("type"), F.col("file_path")))
    c = rerank.boost(c, "named", (F.col("type") == "code") & rerank.names_symbol(F.array().cast("array<string>"), F.col("content"), ["the", "en"]))
    c = rerank.boost(c, "mentioned", (F.col("type") == "code") & rerank.mentions(F.col("file_path"), ["d0/f0.ts", "src3/d3/f3.ts"]))
    return c.select("vec_id", "type", F.round("score", 6).alias("score"))


PULLS = inputs.Values(
    "pr_number int, score double, resolved_by string",
    ((1, 0.3, "c4ca4238"), (2, 0.1, "c81e728d"), (3, 0.2, ""), (4, 0.5, "eccbc87e"), (5, 0.7, "a87ff679"), (6, 0.4, "e4da3b7f")),
)


def pr_commit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.commits(spark, sf_dir)
    present = c.where("date < timestamp '1995-02-01'").select("hash")
    return rerank.pull_chain(PULLS.df(spark), c.select("hash", "file_path"), present).select("hash", "file_path", F.round("score", 6).alias("score"))


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = intent.classify(QUESTIONS.df(spark, sf_dir))
    return df.select("id", "intent", *(f"n_{i}" for i in intent.INTENTS[:4]), *(F.round(f"p_{i}", 6).alias(f"p_{i}") for i in intent.INTENTS), *(F.round(c, 6).alias(c) for c in intent.BLENDED))


def intent_sql() -> str:
    names = intent.INTENTS
    count = lambda i: f"cast(len(regexp_extract_all(question, '{intent.pattern(intent.WORDS[i]).replace(chr(39), chr(39) * 2)}')) as integer) as n_{i}"
    e = ", ".join([*(f"exp((n_{i} - most) / 1.5) as e_{i}" for i in names[:4]), "exp((most * 0.15 - most) / 1.5) as e_general"])
    total = " + ".join(f"e_{i}" for i in names)
    p = ", ".join(f"case when most > 0 then e_{i} / ({total}) else {1.0 if i == 'general' else 0.0} end as p_{i}" for i in names)
    pick = " ".join(f"when p_{i} >= greatest({', '.join('p_' + j for j in names)}) then '{i}'" for i in names)
    blends = ", ".join(f"round({' + '.join(f'p_{i} * {intent.PROFILES[i][k]}' for i in names)}, 6) as {b}" for k, b in enumerate(intent.BLENDED))
    return f"""with c as (select id, question, {', '.join(map(count, names[:4]))} from {QUESTIONS.sql()}),
m as (select *, greatest(n_overview, n_historical, n_implementation, n_debugging)::double as most from c), x as (select *, {e} from m), p as (select *, {p} from x)
select id, case {pick} end as intent, {', '.join('n_' + i for i in names[:4])}, {', '.join(f'round(p_{i}, 6) as p_{i}' for i in names)}, {blends} from p"""


def temporal_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUESTIONS.df(spark, sf_dir).select("id", intent.anchor(F.col("question"), inputs.now().cast("date")).alias("anchor"))


ANCHOR_SQL = f"""with q as (select id, question, date '2024-02-01' as now_,
  regexp_extract(lower(question), '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\w*\\s+(20\\d{{2}})\\b', ['m', 'y']) as my,
  regexp_extract(lower(question), '\\b(\\d+)\\s+(year|month|week|day)s?\\s+ago\\b', ['n', 'u']) as ago,
  regexp_extract(lower(question), '\\blast\\s+(year|month|week)\\b', 1) as last_,
  regexp_extract(question, '\\b(20\\d{{2}})\\b', 1) as y from {QUESTIONS.sql()})
select id, cast(case
  when my.m <> '' then make_date(try_cast(my.y as integer), list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], my.m)::integer, 15)
  when ago.n <> '' then case ago.u when 'year' then now_ - to_years(try_cast(ago.n as integer)) when 'month' then now_ - to_months(try_cast(ago.n as integer)) when 'week' then now_ - to_days(7 * try_cast(ago.n as integer)) else now_ - to_days(try_cast(ago.n as integer)) end
  when last_ <> '' then case last_ when 'year' then now_ - to_years(1) when 'month' then now_ - to_months(1) else now_ - to_days(7) end
  when regexp_matches(lower(question), '\\b(recently|recent|lately)\\b') then now_ - to_months(1)
  when y <> '' then make_date(try_cast(y as integer), 7, 1) end as date) as anchor from q"""


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return QUESTIONS.df(spark, sf_dir).select("id", F.array_join(F.array_distinct(intent.symbols(q)), ",").alias("symbols"), F.array_join(intent.mentioned_files(q), ",").alias("files"), intent.wants_synthesis(q).alias("synthesis"))


TERMS_SQL = f"""with q as (select id, question, list_transform(regexp_extract_all(question, '\\b([a-zA-Z_$][\\w$]*)\\s*\\(', 1), lambda x: lower(x)) as called,
  list_transform(regexp_extract_all(question, '(?i)\\b(next|handle|dispatch|process|route|iterate|middleware|resolver)\\b', 1), lambda x: lower(x)) as loops from {QUESTIONS.sql()}),
e as (select id, question, called || loops as w from q),
s as (select id, array_to_string(list(x order by first_), ',') as symbols from (select id, x, min(i) as first_ from (select id, unnest(w) as x, generate_subscripts(w, 1) as i from e) group by all) group by id)
select e.id, coalesce(symbols, '') as symbols, array_to_string(regexp_extract_all(question, '(?i)(?:^|\\s|[''"`])((?:[\\w.-]+/)+[\\w.-]+\\.[a-z]{{1,4}})\\b', 1), ',') as files,
  regexp_matches(question, '{intent.FLOW}') as synthesis from e left join s using (id)"""

HITS = inputs.Values("type string, file_path string, start_line int, score double", tuple(("code" if i % 4 else "commit", f"src/{'abcdefgh'[i % 8]}.ts", 10 * i + 1, round(0.1 + (i * 37 % 23) / 23, 4)) for i in range(40)))


def best_chunk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.best_per_file(HITS.df(spark), 5, "start_line").select("file_path", "start_line", "score", "place")


def files_to_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = expand.best_per_file(HITS.df(spark), 3, "start_line")
    degree = spark.createDataFrame([("src/z.ts", 9), ("src/b.ts", 7), ("src/y.ts", 7), ("src/x.ts", 2)], "file_path string, degree long")
    known = spark.createDataFrame([("lib/z.ts",), ("src/z.ts",), ("lib/q/w.go",)], "file_path string")
    return expand.files_to_expand(top, expand.anchors(degree), expand.mentioned(known, ["z.ts", "q/w.go", "none.js"]))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one question: rank, type, cost, expanded, taken."""
    s = rerank.ranked(streams(spark, sf_dir), "type", "vec_id")
    cost = rerank.snippet_chars(F.col("type"), F.col("content"), F.col("content"), F.array("file_path"), F.col("content"), F.col("content"), F.col("content"), F.lit(""))
    expanded = (F.col("type") == "code") & (F.col("vec_id") % 4 == 0)
    return s.select("rank", "type", "vec_id", cost.alias("cost"), expanded.alias("expanded"), (expanded & (F.col("vec_id") % 8 == 0)).alias("taken"))


def snippet_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("vec_id", "type", "cost", "expanded", "taken")


SNIPPET_SQL = f"""select vec_id, type, cast(case type when 'commit' then 80 + length(content) + length(content) + length(file_path) when 'code' then 80 + length(content)
  else 80 + length(content) + least(length(content), 500) end as integer) as cost, type = 'code' and vec_id % 4 = 0 as expanded, type = 'code' and vec_id % 8 = 0 as taken from {STREAMS_SQL}"""


def greedy_budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.fill(candidates(spark, sf_dir), 24_000, 16_000, commit_first=False).select("rank", "vec_id", "type", "cost", "place")


def greedy_commit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.fill(candidates(spark, sf_dir), 16_000, 12_000, commit_first=True).select("rank", "vec_id", "type", "cost", "place")


def expansion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = inputs.files(spark, sf_dir).select("file_path", F.col("doc_id").alias("place"), F.length("content").alias("cost"))
    return budget.expansions(sized, 60_000)


def fill_sql(code: int, commit: int, commit_first: bool) -> str:
    """The fold over candidates by recursion: taken results, then seeds, then the others one after the other."""
    favoured = "type <> 'code'" if commit_first else "type = 'code'"
    full = f"case when type = 'code' then code + cost > {code} else commits + cost > {commit} end"
    return f"""with recursive x as materialized (select x.*, cast(row_number() over (order by r.score, r.type, r.vec_id) as integer) as rank from ({SNIPPET_SQL}) x join {STREAMS_SQL} r on r.vec_id = x.vec_id and r.type = x.type),
seeds as (select type, min(rank) as rank, case when (type = 'commit') = {commit_first} then 0 else 1 end as seed from x where type = 'commit' or (type = 'code' and not expanded) group by type),
t as (select rank, row_number() over (order by rank) - 1 as place from x where taken), s as (select x.*, seed, row_number() over (order by seed) - 1 + (select count(*) from t) as place from x join seeds using (rank) where not taken),
rest as materialized (select *, row_number() over (order by rank) as n from x where not taken and rank not in (select rank from seeds)),
f(n, rank, code, commits, done, size, placed) as (
  select 0::bigint, 0, coalesce((select sum(cost) from s where type = 'code'), 0)::bigint, coalesce((select sum(cost) from s where type <> 'code'), 0)::bigint, false, (select count(*) from t) + (select count(*) from s), false
  union all
  select n, rank, code + case when not skip and type = 'code' then cost else 0 end, commits + case when not skip and type <> 'code' then cost else 0 end, done or (not skip and above and size > 0),
    size + case when skip or (above and size > 0) then 0 else 1 end, not (skip or (above and size > 0))
  from (select r.*, code, commits, done, size, code + commits + cost > {code + commit} as above, done or (type = 'code' and expanded) or ({full} and (not ({favoured}) or code + commits + cost > {code + commit})) as skip from f join rest r on r.n = f.n + 1)
)
select x.rank, vec_id, type, cost, cast(place as integer) as place from x left join (select rank, place from t union all select rank, place from s union all select rank, size - 1 from f where placed) p on p.rank = x.rank"""


EXPANSION_SQL = f"""with recursive d as materialized (select file_path, doc_id as place, cast(length(content) as integer) as cost, row_number() over (order by doc_id, file_path) as n from {inputs.FILES_SQL}),
f(n, used, kept) as (select 0::bigint, 0::bigint, false union all select d.n, used + case when used + cost + {budget.HEADER} <= {60_000 * budget.SHARE} then cost + {budget.HEADER} else 0 end, used + cost + {budget.HEADER} <= {60_000 * budget.SHARE} from f join d on d.n = f.n + 1)
select file_path, place, cost, kept from d join f using (n)"""


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inputs.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return budget.history(m, 1500, by=["conv_id"]).select("conv_id", "turn", "role", "chars")


def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.operators import prompt

    return prompt.stats(streams(spark, sf_dir), 3)


QUERIES = {f.__name__: f for f in (
    knn_topk, knn_prefix_scoped, knn_filtered, knn_scoped_global_split, knn_quantised_refine, ann_all_lists, union_streams_rerank, rerank_anchor, boosts, pr_commit_chain,
    intent_classify, temporal_anchor, question_terms, best_chunk_per_file, files_to_expand, snippet_costs, greedy_budget_fill, greedy_commit_first, expansion_budget, history_trim, context_stats,
)}


def knn_sql(where: str = "true", k: int = K) -> str:
    return f"select vec_id, file_path, round(score, 6) as score from (select vec_id, file_path, {distance_sql()} as score from {CHUNKS_SQL} where {where} order by score, vec_id limit {k})"


PLAIN_SQL = f"select vec_id, round(score, 6) as score from (select vec_id, {distance_sql('embedding')} as score from embeddings order by score, vec_id limit {K})"
SQL = {
    "knn_topk": f"select vec_id, round(score, 6) as score, cast(row_number() over (order by score, vec_id) as integer) as rank from (select vec_id, {distance_sql('embedding')} as score from embeddings order by score, vec_id limit {K})",
    "knn_prefix_scoped": knn_sql("starts_with(file_path, 'src1')"),
    "knn_filtered": knn_sql("contains(content, '|')"),
    "knn_scoped_global_split": f"select * from ({knn_sql(f'''starts_with(file_path, case when exists (select 1 from {CHUNKS_SQL} where starts_with(file_path, 'src2/d1')) then 'src2/d1' else 'src2' end)''', 12)}) union all select * from ({knn_sql(k=8)})",
    "knn_quantised_refine": f"""with q as (select list_transform(embedding, lambda x: round(x::double * 127)) as c from embeddings where vec_id = 0),
      r as (select vec_id, embedding, list_sum(list_transform(list_zip(list_transform(embedding, lambda x: round(x::double * 127)), (select c from q)), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as rough from embeddings order by rough, vec_id limit {3 * K})
      select vec_id, round(score, 6) as score from (select vec_id, {distance_sql('embedding')} as score from r order by score, vec_id limit {K})""",
    "ann_all_lists": PLAIN_SQL,
    "union_streams_rerank": rerank_sql(f"1 + 0.4 * least(greatest({YEARS_SQL.format(a=NOW_SQL, b='date')}, 0.0) / 2.0, 3.0)"),
    "rerank_anchor": rerank_sql(f"1 + 0.5 * least(abs({YEARS_SQL.format(a='date', b=chr(39).join(['timestamp ', '1998-07-01 00:00:00', '']))}) / 1.5, 3.0)"),
    "boosts": f"""select vec_id, type, round(score * case when type = 'code' and regexp_matches(file_path, '(?i)readme|package\\.json|index\\.[tj]sx?$|app\\.[tj]sx?$|main\\.[tj]sx?$|\\.md$') then 0.5 else 1.0 end
      * case when type = 'code' and regexp_matches(content, '(?i)(?:function\\s+(?:the|en)\\b|(?:var|let|const)\\s+(?:the|en)\\s*=\\s*function)') then 0.4 else 1.0 end
      * case when type = 'code' and (file_path in ('d0/f0.ts', 'src3/d3/f3.ts') or ends_with(file_path, '/d0/f0.ts') or ends_with(file_path, '/src3/d3/f3.ts')) then 0.3 else 1.0 end, 6) as score from {STREAMS_SQL}""",
    "pr_commit_chain": f"""with best as (select * from {PULLS.sql()} where resolved_by <> '' order by score, pr_number limit 3)
      select hash, min_by(file_path, (score, pr_number, file_path)) as file_path, round(min(score) * 1.05, 6) as score from {inputs.COMMITS_SQL} c join best on starts_with(hash, resolved_by)
      where date >= timestamp '1995-02-01' group by hash""",
    "intent_classify": intent_sql(),
    "temporal_anchor": ANCHOR_SQL,
    "question_terms": TERMS_SQL,
    "best_chunk_per_file": f"""with r as (select *, row_number() over (partition by file_path order by score, start_line) as n from {HITS.sql()} where type = 'code')
      select file_path, start_line, score, cast(row_number() over (order by score, file_path) as integer) as place from (select * from r where n = 1 order by score, file_path limit 5)""",
    "files_to_expand": f"""with r as (select *, row_number() over (partition by file_path order by score, start_line) as n from {HITS.sql()} where type = 'code'),
      top as (select file_path, 0 as part, row_number() over (order by score, file_path) as place from r where n = 1 order by score, file_path limit 3),
      every as (select * from top union all select * from (values ('src/z.ts', 1, 1), ('src/b.ts', 1, 2), ('src/y.ts', 1, 3), ('lib/z.ts', 2, 0), ('lib/q/w.go', 2, 1)) t(file_path, part, place)),
      once as (select file_path, min((part, place)) as p from every group by file_path)
      select file_path, cast(row_number() over (order by p, file_path) as integer) as place from once""",
    "greedy_budget_fill": fill_sql(24_000, 16_000, False),
    "greedy_commit_first": fill_sql(16_000, 12_000, True),
    "expansion_budget": EXPANSION_SQL,
    "snippet_costs": SNIPPET_SQL,
    "history_trim": """with b as (select *, row_number() over (partition by conv_id order by turn desc, text desc) as n from conversations),
      c as (select *, sum(length(text)) over (partition by conv_id order by turn desc, text desc rows unbounded preceding) as chars from b where n <= 10)
      select conv_id, turn, role, cast(chars as bigint) as chars from c where chars <= 1500""",
    "context_stats": f"select count(*) filter (type = 'code') as code, count(*) filter (type = 'commit') as commits, count(*) filter (type = 'pr') as pulls, 3::bigint as expanded from {STREAMS_SQL}",
}
