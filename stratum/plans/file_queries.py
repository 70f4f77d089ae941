"""Queries over paths, texts, chunks, diffs and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import paths, text
from stratum.operators import chunk, diff
from stratum.plans import inputs
from stratum.plans.inputs import FILES_SQL, Grouped, Spread, Values
from stratum.sources import git, pulls, store

NAMED = Values("named string", tuple((p,) for p in (
    "a.png", "yarn.lock", ".env.local", "src/dist/x.ts", "src/app.ts", "dist/x.ts", "lib/router/../x/./y.JS", "README.md", "docs/Contributing.rst", "deep.dir/file", "Cargo.toml", "k/id_rsa.pub",
    "a/b.secret.json", "x.tsx", "q.graphql", "/etc/passwd", "../up.py", "node_modules/m/index.js", "web/node_modules/m/i.js", "s.PEM", "Makefile", "a/../../b//c.go", "build", "x/build/y.c", "l.sql", "license", "w.ex",
)))
CASES = Values("number int, said string", (
    (1, "Fixes #12, closes #7 resolved #12 fix #9"), (2, ""), (3, "nothing here #5"), (4, "FIXED   #100 and Close #3, fixes#4, resolve #100"), (5, "closes #1 closed #2 close #3 fixed #4 fixes #5 fix #6 resolve #7 resolved #8 resolves #9"),
))


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


EXT_OF = "lower(regexp_extract(path, '(\\.[^.]*)$', 1))"
EXCLUDED_SQL = f"({EXT_OF} in ({quoted(paths.BINARY_EXTENSIONS)}) or string_split(path, '/')[-1] in ({quoted(paths.LOCK_FILES)}) or regexp_matches(path, '{paths.SENSITIVE}'))"
DIRS_SQL = " or ".join(f"starts_with(path, '{d}') or contains(path, '/{d}')" for d in [paths.STORE_DIR, *paths.GENERATED_DIRS])


#: All documents as files, below their sources or not, and as bodies that mention issues.
PATHS = Spread(NAMED, "documents", "doc_id", f"case when doc_id < {len(NAMED.rows)} then named when doc_id % 9 = 0 then concat('/', doc_id, '/', named) when doc_id % 9 = 1 then concat('../', doc_id, '/', named) else concat(source, '/d', doc_id, '/', named) end as path")
BODIES = Spread(CASES, "documents", "doc_id", "doc_id as id; concat(said, ' ', text) as body")


def path_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return PATHS.df(spark, sf_dir).select("path", paths.excluded(p).alias("in_diff"), paths.excluded(p, sources=True).alias("in_sources"), paths.is_safe(p).alias("safe"))


def diff_budget_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return PATHS.df(spark, sf_dir).select("path", paths.extension(p).alias("ext"), paths.diff_budget(p).alias("budget"), paths.language(p).alias("language"), paths.is_document(p).alias("document"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return PATHS.df(spark, sf_dir).select("path", paths.normalized(p).alias("normal"), paths.directory(p).alias("folder"))


def linked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BODIES.df(spark, sf_dir).select("id", F.array_join(F.transform(text.linked_issues(F.col("body")), lambda x: x.cast("string")), ",").alias("issues"))


PULLS = Values("number int, title string, body string, state string, merged_at timestamp, merged_by string, user string, created_at timestamp, merge_commit_sha string, updated_at timestamp", tuple(
    (n, f"Pull {n}", body, "closed" if n % 3 else "open", None, "m" if n % 2 else None, None if n == 4 else f"u{n}", None, "ab" * 20 if n % 2 else None, None) for n, body in ((1, "Fixes #12 and closes #7"), (2, None), (3, "x" * 2500), (4, "resolves #1"), (5, ""))
))


def pull_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pull requests as stored ones; the merge state comes from a date that every fifth lacks."""
    raw = PULLS.df(spark).withColumn("merged_at", F.when(F.col("number") % 2 == 1, inputs.now()))
    titles = spark.createDataFrame([(12, "Crash"), (1, "Leak")], "issue int, title string")
    out = pulls.normalised(raw, titles)
    return out.select("pr_number", "title", F.length("description").alias("chars"), "state", "author", "merged_by", F.array_join("linked_issues", ", ").alias("issues"), "resolved_by",
                      pulls.embedding_text(out).alias("embedded"))


PULL_SQL = f"""with raw as (select *, case when number % 2 = 1 then 'merged' when state = 'closed' then 'closed' else 'open' end as s, coalesce(body, '') as b from {PULLS.sql()}),
i as (select number, list_transform(regexp_extract_all(b, '(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\\s+#(\\d+)', 1), lambda x: case x when '12' then 'Crash (#12)' when '1' then 'Leak (#1)' else '#' || x end) as l from raw),
r as (select number as pr_number, title, substr(b, 1, 2000) as d, s as state, coalesce("user", 'unknown') as author, coalesce(merged_by, '') as merged_by, array_to_string(l, ', ') as issues, coalesce(merge_commit_sha, '') as resolved_by from raw join i using (number))
select pr_number, title, cast(length(d) as integer) as chars, state, author, merged_by, issues, resolved_by,
  concat_ws(chr(10), 'PR #' || pr_number || ': ' || title, 'State: ' || state || ' | Author: ' || author || case when merged_by <> '' then ' | Merged by: ' || merged_by else '' end,
  nullif(d, ''), 'Linked issues: ' || nullif(issues, ''), 'Merge commit: ' || substr(nullif(resolved_by, ''), 1, 8)) as embedded from r"""


def freshness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    d, now = F.col("o_orderdate"), F.lit("2001-08-02 00:00:00").cast("timestamp")
    return o.select("o_orderkey", text.freshness(d, now).alias("label"), text.relative_age(d, now).alias("age"), F.round(text.decay(d, now), 6).alias("decay"))


FRESH_SQL = """with d as (select o_orderkey, floor((epoch_ms(timestamp '2001-08-02') - epoch_ms(o_orderdate)) / 86400000.0)::bigint as d, (epoch_ms(timestamp '2001-08-02') - epoch_ms(o_orderdate)) / 86400000.0 as x from orders)
select o_orderkey, case when d < 180 then 'Modern' when d < 540 then 'Recent' else 'Stale' end as label,
  case when d < 1 then 'today' when d = 1 then 'yesterday' when d < 7 then d || ' days ago' when d < 30 then (d // 7) || ' weeks ago' when d < 365 then (d // 30) || ' months ago'
       when d // 365 = 1 then '1 year ago' else (d // 365) || ' years ago' end as age, round(exp(-ln(2) / 365 * greatest(x, 0)), 6) as decay from d"""


def commit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.commits(spark, sf_dir)
    body = text.commit_text(F.col("hash"), F.col("author"), F.date_format("date", "yyyy-MM-dd"), F.col("message"), F.col("file_path"), F.array("file_path", F.col("author")), F.when(F.col("message").startswith("1"), "+x").otherwise(""))
    return c.select("hash", "file_path", F.md5(body.cast("binary")).alias("text_md5"))


COMMIT_TEXT_SQL = f"""select hash, file_path, md5(concat_ws(chr(10), '[COMMIT: ' || substr(hash, 1, 8) || '] Author: ' || author || ' | Date: ' || strftime(date, '%Y-%m-%d'), '[MESSAGE]: ' || message, '[FILE]: ' || file_path,
  '[OTHER FILES]: ' || file_path || ', ' || author, case when starts_with(message, '1') then '[DIFF]:' || chr(10) || '+x' end)) as text_md5 from {inputs.COMMITS_SQL}"""


def code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.windows(inputs.files(spark, sf_dir), 8, 2)
    none = F.array().cast("array<string>")
    odd = F.col("start_line") % 12 == 1
    body = text.code_text(F.col("file_path"), F.col("language"), F.col("start_line"), F.col("end_line"), F.col("content"), F.when(odd, F.array(F.lit("f"), F.lit("g"))).otherwise(none), none, F.when(odd, F.array(F.lit("./x"))).otherwise(none), none, F.lit(False))
    return c.select("file_path", "start_line", F.md5(body.cast("binary")).alias("text_md5"))


def windows_sql(size: int, overlap: int, select: str = "file_path, language, start_line, end_line, md5(content) as content_md5") -> str:
    stride = size - overlap
    return f"""with lined as (select file_path, case {EXT_OF.replace('path', 'file_path')} {' '.join(f"when '{k}' then '{v}'" for k, v in paths.LANGUAGES.items() if k in ('.ts', '.py', '.md', '.sql'))} end as language, string_split(content, chr(10)) as lines from {FILES_SQL}),
s as (select *, unnest(range(0, cast(ceil(greatest(len(lines) - {size}, 0) / {stride}.0) as bigint) * {stride} + 1, {stride})) as st from lined),
w as (select file_path, language, cast(st + 1 as integer) as start_line, cast(least(st + {size}, len(lines)) as integer) as end_line, array_to_string(lines[st + 1 : st + {size}], chr(10)) as content from s),
c as (select * from w where length(regexp_replace(content, '\\s', '', 'g')) >= 20)
select {select} from c"""


def windows(size: int, overlap: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.windows(inputs.files(spark, sf_dir), size, overlap).select("file_path", "language", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))

    return run


def near_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.files(spark, sf_dir).where(~chunk.dense(F.col("content"))).select("file_path", "content")


def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.windows(inputs.files(spark, sf_dir), 8, 2, summaries=True).where("is_summary")
    return out.select("file_path", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


SUMMARY_SQL = f"""with l as (select file_path, string_split(content, chr(10)) as l, {' '.join(['case', EXT_OF.replace('path', 'file_path'), *(f"when '{k}' then '{v}'" for k, v in paths.LANGUAGES.items() if k in ('.ts', '.py', '.md', '.sql'))])} end as g from {FILES_SQL})
select file_path, cast(len(l) as integer) as end_line, md5(concat_ws(chr(10), '[SUMMARY] File: ' || file_path || ' | Language: ' || g || ' | ' || len(l) || ' lines', '--- HEAD ---', array_to_string(l[1:80], chr(10)), '--- TAIL ---', array_to_string(l[greatest(len(l) - 39, 1):], chr(10)))) as content_md5 from l where len(l) > 8"""

SYMBOLS = Grouped(Values("file_path string, kind string, name string, owner string, start_line int, end_line int, ord int", (
    ("a.ts", "class", "Box", "", 1, 30, 0), ("a.ts", "function", "open", "Box", 2, 9, 1), ("a.ts", "method", "close", "Box", 10, 28, 2), ("a.ts", "import", "./b", "", 1, 1, 3), ("a.ts", "export", "Box", "", 30, 30, 4),
    ("a.ts", "function", "late", "", 31, 45, 5), ("b.ts", "function", "one", "", 1, 3, 0), ("b.ts", "import", "../c", "", 12, 12, 1),
)), "part", "p_partkey")
SPANS = Grouped(Values("file_path string, start_line int, end_line int, is_summary boolean", (("a.ts", 1, 10, False), ("a.ts", 9, 18, False), ("a.ts", 17, 26, False), ("a.ts", 25, 34, False), ("a.ts", 1, 45, True), ("b.ts", 1, 10, False), ("b.ts", 9, 18, False), ("c.ts", 1, 5, False))), "part", "p_partkey")


def range_overlap_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.tagged(SPANS.df(spark, sf_dir), SYMBOLS.df(spark, sf_dir))
    return out.select("file_path", "start_line", "end_line", *(F.array_join(c, ",").alias(c) for c in ("functions", "classes", "imports", "exports")))


def tag_sql(name: str, *kinds: str) -> str:
    return f"coalesce(string_agg(name, ',' order by ord) filter (kind in ({quoted(list(kinds))})), '') as {name}"


DIFF = """preamble
diff --git a/src/a.ts b/src/a.ts
index 1..2
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,2 +1,3 @@
 same
+new line of some length
-old line
 same
diff --git a/q.sql b/q.sql
--- a/q.sql
+++ b/q.sql
@@ -1 +1 @@
+select 1
"""
DIFFS = Values("hash string, diff string, budget int", (("h1", DIFF, 3000), ("h2", DIFF, 90), ("h3", "", 600), ("h4", "no diff here", 600), ("h5", DIFF * 3, 64)))


def split_and_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.by_file(DIFFS.df(spark))
    return out.select("hash", "file_path", "place", F.md5(F.col("raw_diff").cast("binary")).alias("raw_md5"), diff.condensed(F.col("raw_diff"), F.col("budget")).alias("condensed"))


SPLIT_SQL = f"""with p as (select hash, budget, string_split(replace(chr(10) || diff, chr(10) || 'diff --git ', chr(1) || 'diff --git '), chr(1)) as parts from {DIFFS.sql()}),
f as (select hash, budget, unnest(parts[2:]) as part, generate_subscripts(parts[2:], 1) as place, len(parts) as n from p),
r as (select hash, budget, cast(place - case when starts_with((select diff from {DIFFS.sql()} d where d.hash = f.hash), 'diff --git') then 1 else 0 end as integer) as place, part || case when place < n - 1 then chr(10) else '' end as raw from f),
l as (select *, string_split(raw, chr(10)) as ls from r),
k as (select hash, place, budget, raw, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
kept as (select * from k where regexp_matches(line, '^(diff --git|---|\\+\\+\\+|@@|\\+|-)')),
run as (select *, sum(length(line) + 1) over (partition by hash, place order by i) as used from kept),
agg as (select hash, place, string_agg(line, chr(10) order by i) filter (used <= budget) as body, max(used) > any_value(budget) as over from run group by all)
select r.hash, regexp_extract(r.raw, 'diff --git a/.+ b/(\\S+)', 1) as file_path, r.place, md5(r.raw) as raw_md5, concat_ws(chr(10), body, case when over then '... [diff truncated]' end) as condensed from r join agg using (hash, place)"""


def condense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diffs: every other line starts with a plus."""
    raw = F.array_join(F.transform(F.split("content", "\n", -1), lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise(" "), x)), "\n")
    return inputs.files(spark, sf_dir).select("file_path", F.md5(diff.condensed(raw, F.lit(600)).cast("binary")).alias("condensed_md5"))


CONDENSE_SQL = f"""with l as (select file_path, string_split(content, chr(10)) as ls from {FILES_SQL}), k as (select file_path, '+' || unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
run as (select *, sum(length(line) + 1) over (partition by file_path order by i) as used from k where i % 2 = 1)
select file_path, md5(concat_ws(chr(10), string_agg(line, chr(10) order by i) filter (used <= 600), case when max(used) > 600 then '... [diff truncated]' end)) as condensed_md5 from run group by file_path"""

STATS = Values("hash string, stat string", (("a", " 3 files changed, 10 insertions(+), 2 deletions(-)"), ("b", " 1 file changed, 1 insertion(+)"), ("c", " 2 files changed, 7 deletions(-)"), ("d", "")))


def log_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.contents(STATS.df(spark)).drop("stat")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files now and before: some are new, some gone, some changed."""
    f = inputs.files(spark, sf_dir).select("file_path", "doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    before = f.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return f.where("doc_id % 11 <> 0"), before


def content_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.changes(*snapshots(spark, sf_dir))


HASH_SQL = f"""with f as (select file_path, doc_id, sha256(content) as h from {FILES_SQL}), b as (select file_path, case when doc_id % 5 = 0 then 'old' else h end as h from f where doc_id % 7 <> 0), n as (select * from f where doc_id % 11 <> 0)
select file_path, change from (select coalesce(n.file_path, b.file_path) as file_path, case when b.h is null then 'new' when n.h is null then 'deleted' when b.h <> n.h then 'changed' end as change from n full join b on n.file_path = b.file_path) where change is not null"""


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old snapshot less the changed and deleted files, with the changed and new ones."""
    now, before = snapshots(spark, sf_dir)
    change = store.changes(now, before)
    kept = before.join(change.select("file_path"), "file_path", "left_anti").select("file_path", "content_hash")
    return kept.unionByName(now.join(change.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi").select("file_path", "content_hash"))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk.windows(inputs.files(spark, sf_dir), 8, 2, summaries=True)
    p = inputs.table(spark, sf_dir, "pages")
    return store.status(inputs.commits(spark, sf_dir), c, p)


STATUS_SQL = f"""select (select count(*) from {inputs.COMMITS_SQL}) as commit_rows, (select count(distinct hash) from {inputs.COMMITS_SQL}) as commits, c.chunks + s.n as chunks, s.files as files, s.n as summaries, (select count(*) from pages) as pulls
from (select count(*) as chunks from ({windows_sql(8, 2)})) c, (select count(*) filter (len(string_split(content, chr(10))) > 8) as n, count(distinct file_path) filter (length(regexp_replace(content, '\\s', '', 'g')) >= 20 or len(string_split(content, chr(10))) > 8) as files from {FILES_SQL}) s"""


def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unique_paths(inputs.files(spark, sf_dir))


def chunks_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = inputs.files(spark, sf_dir).where("doc_id % 50 = 3")
    return store.chunks_of(chunk.windows(inputs.files(spark, sf_dir), 8, 2), wanted).select("file_path", "start_line", "end_line")


def commits_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_hash(inputs.commits(spark, sf_dir), "c4ca").select("hash", "file_path", "score")


def recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(inputs.commits(spark, sf_dir), 40).select("hash", "date", "author", "file_path")


def latest_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("pr_number"), "url")
    new = old.where("pr_number % 3 = 0").select("pr_number", F.concat("url", F.lit("#new")).alias("url"))
    return store.latest_pulls(old, new)


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REMOTES.df(spark).select("remote", *(c.alias(n) for n, c in zip(("owner", "repo"), git.repository(F.col("remote")))))


REMOTES = Values("remote string", tuple((r,) for r in ("git@host.example:own/re-po.git", "https://host.example/own/repo", "https://host.example/own/repo.git", "own/repo", "nothing", "")))

QUERIES = {f.__name__: f for f in (
    path_exclusion, diff_budget_class, path_normalize, linked_issues, pull_rows, freshness_labels, commit_text, code_text, near_empty, file_summary, range_overlap_tag, split_and_condense, condense_lines, log_contents,
    content_hash_diff, upsert_snapshot, index_status, unique_paths, chunks_of_files, commits_by_prefix, recent_commits, latest_pulls, remotes,
)} | {f"line_windows_{a}_{b}": windows(a, b) for a, b in ((8, 2), (32, 8), (256, 50))}
SQL = {
    "path_exclusion": f"select path, {EXCLUDED_SQL} as in_diff, {EXCLUDED_SQL} or {DIRS_SQL} as in_sources, not starts_with(path, '/') and not contains(path, '..') as safe from {PATHS.sql()}",
    "diff_budget_class": f"""select path, {EXT_OF} as ext, case when {EXT_OF} in ({quoted(paths.CODE_EXTENSIONS)}) then 3000 when {EXT_OF} in ({quoted(paths.SCRIPT_EXTENSIONS)}) then 1500 else 600 end as budget,
      case {EXT_OF} {' '.join(f"when '{k}' then '{v}'" for k, v in paths.LANGUAGES.items())} else 'unknown' end as language, regexp_matches(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', ''), '{paths.DOC_NAME}') as document from {PATHS.sql()}""",
    "path_normalize": f"""with recursive w as (select path, list_filter(string_split(path, '/'), lambda x: x not in ('', '.')) as p from {PATHS.sql()}),
      r(path, p, i, acc) as (select path, p, 1, []::varchar[] from w union all select path, p, i + 1, case when p[i] = '..' then acc[:len(acc) - 1] else list_append(acc, p[i]) end from r where i <= len(p))
      select path, array_to_string(acc, '/') as normal, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') as folder from r where i = len(p) + 1""",
    "linked_issues": f"""with m as (select id, regexp_extract_all(body, '(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\\s+#(\\d+)', 1) as l from {BODIES.sql()}), e as (select id, unnest(l) as x, generate_subscripts(l, 1) as i from m),
      f as (select id, x, min(i) as i from e group by all) select m.id, coalesce((select string_agg(x, ',' order by i) from f where f.id = m.id), '') as issues from m""",
    "pull_rows": PULL_SQL,
    "freshness_labels": FRESH_SQL,
    "commit_text": COMMIT_TEXT_SQL,
    "code_text": windows_sql(8, 2, """file_path, start_line, md5(concat_ws(chr(10), '[CODE] File: ' || file_path || ' | Language: ' || language || ' | Lines ' || start_line || '-' || end_line,
      case when start_line % 12 = 1 then '[DEFINES] f, g' end, case when start_line % 12 = 1 then '[IMPORTS] ./x' end, content)) as text_md5"""),
    "near_empty": f"select file_path, content from {FILES_SQL} where length(regexp_replace(content, '\\s', '', 'g')) < 20",
    "file_summary": SUMMARY_SQL,
    "range_overlap_tag": f"""select c.file_path, c.start_line, c.end_line, {tag_sql('functions', 'function', 'method')}, {tag_sql('classes', 'class')}, {tag_sql('imports', 'import')}, {tag_sql('exports', 'export')}
      from {SPANS.sql()} c left join {SYMBOLS.sql()} s on s.file_path = c.file_path and s.start_line <= c.end_line and s.end_line >= c.start_line and not c.is_summary group by all""",
    "split_and_condense": SPLIT_SQL,
    "condense_lines": CONDENSE_SQL,
    "log_contents": f"""with x as (select hash, coalesce(try_cast(regexp_extract(stat, '(\\d+) insertion', 1) as bigint), 0) as insertions, coalesce(try_cast(regexp_extract(stat, '(\\d+) deletion', 1) as bigint), 0) as deletions from {STATS.sql()}) select *, insertions + deletions as lines_changed from x""",
    "content_hash_diff": HASH_SQL,
    "upsert_snapshot": f"select file_path, sha256(content) as content_hash from {FILES_SQL} where doc_id % 11 <> 0",
    "index_status": STATUS_SQL,
    "unique_paths": f"select distinct file_path from {FILES_SQL}",
    "chunks_of_files": f"select file_path, start_line, end_line from ({windows_sql(8, 2)}) where file_path in (select file_path from {FILES_SQL} where doc_id % 50 = 3)",
    "commits_by_prefix": f"select hash, file_path, 0.0::double as score from {inputs.COMMITS_SQL} where starts_with(hash, 'c4ca')",
    "recent_commits": f"select hash, min(date) as date, min(author) as author, min(file_path) as file_path from {inputs.COMMITS_SQL} group by hash order by date desc, hash limit 40",
    "latest_pulls": "select page_id::integer as pr_number, case when page_id % 3 = 0 then url || '#new' else url end as url from pages",
    "remotes": f"""with m as (select remote, regexp_extract(remote, '(?:^|[:/])([\\w.-]+)/([\\w.-]+?)(?:\\.git)?/?$', ['a', 'b']) as x from {REMOTES.sql()}) select remote, nullif(x.a, '') as owner, nullif(x.b, '') as repo from m""",
} | {f"line_windows_{a}_{b}": windows_sql(a, b) for a, b in ((8, 2), (32, 8), (256, 50))}
