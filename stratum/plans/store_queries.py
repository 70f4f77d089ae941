"""Queries that go through the store, and from source files to symbols and call edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum import schemas, scratch
from stratum.functions import intent
from stratum.operators import chunk, graph, rerank, search, symbols
from stratum.plans import engine, inputs
from stratum.plans.file_queries import windows_sql
from stratum.plans.inputs import CHUNKS_SQL, EDGES_SQL, FILES_SQL, Spread, Values, distance_sql
from stratum.sources import lists
from stratum.sources.store import Store, changes, co_changed_with, edges_from, edges_to
from stratum.streaming import ingest

K = 25


def new_store(spark: SparkSession) -> Store:
    return Store(spark, scratch.folder(spark, "store"))


def stored(df: DataFrame, schema) -> DataFrame:
    """Columns of a stored table, null where the rows lack one."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields))


def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an old snapshot, made and appended to; then changed and new files replaced, and deleted ones removed."""
    now = inputs.files(spark, sf_dir).where("doc_id % 11 <> 0")
    before = inputs.files(spark, sf_dir).where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("stale\n"), F.col("content"))).otherwise(F.col("content")))
    hashed = lambda df: df.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    chunked = lambda df: stored(chunk.windows(df, 8, 2), schemas.CHUNKS)
    store = new_store(spark)
    store.create("code_files", chunked(before.where("lang = 'en'")))
    store.append("code_files", chunked(before.where("not lang <=> 'en'")))
    store.save_hashes(hashed(before))
    change = changes(hashed(now), store.load_hashes())
    gone = change.where("change = 'deleted'").select("file_path")
    anew = change.where("change <> 'deleted'").select("file_path")
    store.replace_files(anew, chunked(now.join(anew, "file_path", "left_semi")))
    store.replace_files(gone)
    return store.read("code_files").select("file_path", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by either end after edges were set, and set again with none, which changes nothing."""
    together = inputs.edges(spark, sf_dir).withColumn("edge_type", F.when(F.col("line") == 1, "co-change").otherwise("call"))
    store = new_store(spark)
    store.set_edges(stored(together, schemas.EDGES))
    store.set_edges(store.read("call_graph").where("false"))
    e = store.read("call_graph")
    sides = {"from": edges_from(e, "lib/s3.ts"), "to": edges_to(e, "lib/s3.ts"), "with": co_changed_with(e, "lib/s3.ts")}
    parts = [df.select(F.lit(side).alias("side"), "caller_file", "caller_name", "callee_file", "callee_name", "line", "edge_type") for side, df in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TYPED_SQL = f"(select *, case when line = 1 then 'co-change' else 'call' end as edge_type from {EDGES_SQL})"
EDGE_SQL = f"""select 'from' as side, * from {TYPED_SQL} where caller_file = 'lib/s3.ts' union all select 'to', * from {TYPED_SQL} where callee_file = 'lib/s3.ts'
union all select 'with', * from {TYPED_SQL} where edge_type = 'co-change' and 'lib/s3.ts' in (caller_file, callee_file)"""


def store_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of two fetches: of one that comes again the new version stays."""
    p = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("pr_number"), F.col("url").alias("title"))
    store = new_store(spark)
    store.create("pr_data", stored(p.where(~F.col("title").endswith("7")), schemas.PULLS))
    store.upsert_pulls(stored(p.where(F.col("title").endswith("7") | F.col("title").endswith("3")).withColumn("state", F.lit("merged")), schemas.PULLS))
    return store.read("pr_data").select("pr_number", "title", "state")


def ann_some_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by two fifths of the lists of an index, half of which was made before the other half was added."""
    rows = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("hash"), F.lit("").alias("file_path"), F.col("embedding").alias("vector"))
    store = new_store(spark)
    index = lists.CodeIndex(store, "commits")
    for part in (0, 1):
        store.append("commits", stored(rows.where(F.col("hash").cast("long") % 2 == part), schemas.COMMITS))
        index.update()
    return index.search(inputs.question(spark, sf_dir), K, ["hash", "file_path"]).select(F.col("hash").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


def store_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and state of a filled store, and of the same one after it was cleared."""
    store = new_store(spark)
    store.create("commits", stored(inputs.commits(spark, sf_dir), schemas.COMMITS))
    store.create("code_files", stored(chunk.windows(inputs.files(spark, sf_dir), 8, 2, summaries=True), schemas.CHUNKS))
    store.append("commits", store.read("commits").where("false"))
    store.save_state(last="abc")
    store.save_state(total=7)
    row = lambda when: store.status().select(F.lit(when).alias("at"), "commit_rows", "commits", "chunks", "files", "summaries", "pulls", F.lit(",".join(f"{k}={v}" for k, v in sorted(store.load_state().items()))).alias("state"))
    full = spark.createDataFrame(row("filled").collect(), row("filled").schema)  # one row, kept before its tables go
    store.clear()
    return full.unionByName(row("cleared"))


CLEARED_SQL = f"""select 'filled' as at, (select count(*) from {inputs.COMMITS_SQL}) as commit_rows, (select count(distinct hash) from {inputs.COMMITS_SQL}) as commits, c.chunks + s.n as chunks, s.files as files, s.n as summaries, 0 as pulls, 'last=abc,total=7' as state
from (select count(*) as chunks from ({windows_sql(8, 2)})) c, (select count(*) filter (len(string_split(content, chr(10))) > 8) as n, count(distinct file_path) filter (length(regexp_replace(content, '\\s', '', 'g')) >= 20 or len(string_split(content, chr(10))) > 8) as files from {FILES_SQL}) s
union all select 'cleared', 0, 0, 0, 0, 0, 0, ''"""


#: A source file by language: {k} is the part, {n} the next one, {f} and {g} what they define, {d} the next one's folder.
SOURCES = {
    ".ts": "import { {g} } from '../{d}/p{n}';\nexport class Box{k} {\n  open(x) {\n    return {g}(x);\n  }\n}\nfunction {f}(a) {\n  {f}(a);\n}",
    ".py": "from .p{n} import {g}\nclass Box{k}:\n    def open(self, x):\n        return {g}(x)\n\ndef {f}(a):\n    {f}(a)\n",
    ".go": 'import "p{n}"\ntype Box{k} struct {\n}\nfunc (b Box{k}) Open(x int) int {\n\treturn {g}(x)\n}\nfunc {f}(a int) {\n\t{f}(a)\n}\n',
    ".cob": "PERFORM {f}(a).\n",
}
#: What each language's file has: kind, name, owner, first and last line, order.
EXPECTED = {
    ".ts": [("class", "Box{k}", "", 2, 6), ("method", "open", "Box{k}", 3, 5), ("function", "{f}", "", 7, 9), ("import", "../{d}/p{n}", "", 1, 1), ("import_name", "{g}", "../{d}/p{n}", 1, 1), ("export", "Box{k}", "", 2, 2), ("call", "{g}", "", 4, 4), ("call", "{f}", "", 8, 8)],
    ".py": [("class", "Box{k}", "", 2, 4), ("method", "open", "Box{k}", 3, 4), ("function", "{f}", "", 6, 7), ("import", ".p{n}", "", 1, 1), ("import_name", "{g}", ".p{n}", 1, 1), ("call", "{g}", "", 4, 4), ("call", "{f}", "", 7, 7)],
    ".go": [("class", "Box{k}", "", 2, 3), ("method", "Open", "Box{k}", 4, 6), ("function", "{f}", "", 7, 9), ("import", "p{n}", "", 1, 1), ("call", "{g}", "", 5, 5), ("call", "{f}", "", 8, 8)],
}


def filled(text: Column) -> Column:
    """A template with a part's own names."""
    k = F.col("p_partkey")
    of = {"{k}": k, "{n}": k + 1, "{f}": F.concat(F.lit("f"), (k % 7).cast("string")), "{g}": F.concat(F.lit("f"), ((k + 1) % 7).cast("string")), "{d}": F.concat(F.lit("d"), ((k + 1) % 10).cast("string"))}
    for mark, value in of.items():
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


def sources(spark: SparkSession, sf_dir: str, of: dict[str, str] = SOURCES) -> DataFrame:
    """Parts as source files of some languages, each of which calls the next one's function, and some their own."""
    k = F.col("p_partkey")
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    path = F.concat(F.lit("gen/d"), (k % 10).cast("string"), F.lit("/p"), k.cast("string"), pick(of))
    return inputs.dealt(inputs.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(path.alias("file_path"), filled(pick(of.values())).alias("content"))


def filled_sql(x: str) -> str:
    for mark, value in (("{k}", "k"), ("{n}", "k + 1"), ("{f}", "'f' || k % 7"), ("{g}", "'f' || (k + 1) % 7"), ("{d}", "'d' || (k + 1) % 10")):
        x = f"replace({x}, '{mark}', ({value})::varchar)"
    return x


def parts_sql(of: dict[str, str]) -> str:
    return f"(select p_partkey as k, e.ext, concat('gen/d', p_partkey % 10, '/p', p_partkey, e.ext) as file_path from part join (values {', '.join(f"({i}, '{x}')" for i, x in enumerate(of))}) e(i, ext) on p_partkey % {len(of)} = e.i)"


def symbols_sql(of: dict[str, str], expected: dict[str, list]) -> str:
    return f"""select file_path, kind, {filled_sql('name')} as name, {filled_sql('owner')} as owner, start_line, end_line, ord from {parts_sql(of)}
join (values {', '.join(f"('{x}', '{kind}', '{name}', '{owner}', {a}, {b}, {i})" for x, found in expected.items() for i, (kind, name, owner, a, b) in enumerate(found))}) s(of, kind, name, owner, start_line, end_line, ord) on of = ext"""


PARTS_SQL, SYMBOLS_SQL = parts_sql(SOURCES), symbols_sql(SOURCES, EXPECTED)


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(sources(spark, sf_dir)).where("kind <> 'param'")


#: Source files whose strings and comments hold brackets and declarations: none of these counts.
LEXED = {
    ".tsx": "import {\n  {g}, // } no\n} from './p{n}';\nclass Box{k} {\n  s = \"}{\";\n  open(x) {\n    return /[}]/.test(x) ? `}${ {g}(`${x}`) }` : 0;\n  }\n}\nexport const {f} = async (a, { p, q }, b = 1) => {\n  {g}(a);\n};\n",
    ".js": "/* function no() { */\nfunction {f}(\n  a,\n  b,\n) {\n  if (a) { {g}('}'); }\n}\nexports.{f} = {f};\n",
    ".py": 'from .p{n} import (\n    {g},\n)\ndef {f}(a: dict[str, int], *rest, k=")"):\n    """doc\nclass No:\n"""\n    return {g}(a)\n',
    ".rs": "use p{n}::{{g}};\n/* a /* b } */ { */\nstruct Box{k}(u8);\nimpl Box{k} {\n    fn {f}(&self, x: &'static str) -> [u8; 2] {\n        let c = '}';\n        {g}(r#\"} \"{\"#)\n    }\n}\n",
    ".java": "import p{n}.{g};\nclass Box{k} {\n  String s = \"}\"; // }\n  public int {f}(Map<String, Integer> a, int b) {\n    return {g}('{');\n  }\n}\n",
    ".c": "#include \"p{n}.h\"\n// int no() {\nstruct Box{k} { int a; };\nstatic int {f}(int a, char *b) {\n  char c = '}';\n  return {g}(\"}{\");\n}\n",
    ".go": "import (\n\t\"p{n}\"\n)\nfunc {f}(a, b int) {\n\ts := `}\n}`\n\t{g}(s)\n}\n",
}
FOUND = {
    ".tsx": [("class", "Box{k}", "", 4, 9), ("method", "open", "Box{k}", 6, 8), ("function", "{f}", "", 10, 12), ("import", "./p{n}", "", 1, 1), ("import_name", "{g}", "./p{n}", 1, 1), ("call", "test", "", 7, 7), ("call", "{g}", "", 7, 7), ("export", "{f}", "", 10, 10), ("call", "{g}", "", 11, 11), ("param", "a", "{f}", 10, 10), ("param", "{ p, q }", "{f}", 10, 10), ("param", "b", "{f}", 10, 10)],
    ".js": [("function", "{f}", "", 2, 7), ("call", "{g}", "", 6, 6), ("export", "{f}", "", 8, 8), ("param", "a", "{f}", 2, 2), ("param", "b", "{f}", 2, 2)],
    ".py": [("function", "{f}", "", 4, 8), ("import", ".p{n}", "", 1, 1), ("import_name", "{g}", ".p{n}", 1, 1), ("call", "{g}", "", 8, 8), ("param", "a", "{f}", 4, 4), ("param", "*rest", "{f}", 4, 4), ("param", "k", "{f}", 4, 4)],
    ".rs": [("class", "Box{k}", "", 3, 3), ("method", "{f}", "Box{k}", 5, 8), ("import", "p{n}", "", 1, 1), ("import_name", "{g}", "p{n}", 1, 1), ("call", "{g}", "", 7, 7), ("param", "&self", "{f}", 5, 5), ("param", "x", "{f}", 5, 5)],
    ".java": [("class", "Box{k}", "", 2, 7), ("method", "{f}", "Box{k}", 4, 6), ("import", "p{n}.{g}", "", 1, 1), ("call", "{g}", "", 5, 5), ("param", "Map", "{f}", 4, 4), ("param", "int", "{f}", 4, 4)],
    ".c": [("class", "Box{k}", "", 3, 3), ("function", "{f}", "", 4, 7), ("import", "p{n}.h", "", 1, 1), ("call", "{g}", "", 6, 6), ("param", "int", "{f}", 4, 4), ("param", "char", "{f}", 4, 4)],
    ".go": [("function", "{f}", "", 4, 8), ("import", "p{n}", "", 2, 2), ("call", "{g}", "", 7, 7), ("param", "a", "{f}", 4, 4), ("param", "b", "{f}", 4, 4)],
}


def lexed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and parameters of parts as source files of seven languages."""
    return symbols.symbols(sources(spark, sf_dir, LEXED))


LEXED_SQL = symbols_sql(LEXED, FOUND)


def code_windows_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four lines of all source files, with the names that each meets."""
    n = F.explode(F.sequence(F.lit(0), F.lit(3)))
    cut = sources(spark, sf_dir).select("file_path", n.alias("i")).select("file_path", (F.col("i") * 3 + 1).alias("start_line"), (F.col("i") * 3 + 4).alias("end_line"), (F.col("i") == 3).alias("is_summary"))
    return chunk.tagged(cut, code_symbols(spark, sf_dir), 4).select("file_path", "start_line", *(F.array_join(c, ",").alias(c) for c in chunk.TAGS))


TAGGED_SQL = f"""with s as ({SYMBOLS_SQL}), c as (select file_path, i * 3 + 1 as a, i * 3 + 4 as b, i = 3 as whole from {PARTS_SQL} cross join (values (0), (1), (2), (3)) t(i))
select c.file_path, a as start_line, {', '.join(f"coalesce(string_agg(name, ',' order by ord) filter (kind in ({', '.join(repr(k) for k in kinds)})), '') as {tag}" for tag, kinds in chunk.TAGS.items())}
from c left join s on s.file_path = c.file_path and s.start_line <= b and s.end_line >= a and not whole group by c.file_path, a"""


def code_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source files to calls by caller, callee and the file that the callee is in."""
    found = code_symbols(spark, sf_dir)
    at = scratch.folder(spark, "symbols")  # read many times, so parsed once
    found.write.parquet(at)
    return graph.call_edges(spark.read.schema(found.schema).parquet(at))


CALLS_SQL = f"""with s as ({SYMBOLS_SQL}), f as (select *, regexp_extract(file_path, '^(.*/)', 1) as folder from s where kind in ('function', 'method')),
c as (select *, regexp_extract(file_path, '^(.*/)', 1) as folder from s where kind = 'call'),
t as (select i.file_path, i.name, p.file_path as target from s i join {PARTS_SQL} p on i.kind = 'import_name' and starts_with(i.owner, '../') and p.ext <> '.cob' and starts_with(p.file_path, replace(i.owner, '../', 'gen/') || '.')),
anywhere as (select name, min_by(file_path, (ord, file_path)) as file_path from f group by name), beside as (select folder, name, min_by(file_path, (ord, file_path)) as file_path from f group by all)
select c.file_path as caller_file, e.name as caller_name, coalesce(o.file_path, t.target, b.file_path, a.file_path, '<external>') as callee_file, c.name as callee_name, c.start_line as line, 'call' as edge_type
from c join f e on e.file_path = c.file_path and c.start_line between e.start_line and e.end_line left join (select distinct file_path, name from f) o on o.file_path = c.file_path and o.name = c.name
left join t on t.file_path = c.file_path and t.name = c.name left join beside b on b.folder = c.folder and b.name = c.name left join anywhere a on a.name = c.name"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in which English ones define a function and those with a bar export something."""
    none = F.array().cast("array<string>")
    return inputs.chunks(spark, sf_dir).withColumns({"functions": F.when(F.col("lang") == "en", F.array("lang")).otherwise(none), "classes": none, "exports": F.when(F.col("content").contains("|"), F.array(F.lit("x"))).otherwise(none)})


def knn_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = described(spark, sf_dir)
    return search.knn(c, inputs.question(spark, sf_dir), K, ["vec_id"], search.with_symbols(c)).select("vec_id", F.round("score", 6).alias("score"))


def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top chunks, and those of a search among chunks with symbols that aren't there yet, at a better score."""
    c, q = described(spark, sf_dir), inputs.question(spark, sf_dir)
    found = search.knn(c, q, K, ["vec_id"]).select("vec_id", "score")
    more = search.knn(c, q, K, ["vec_id"], search.with_symbols(c)).select("vec_id", "score")
    return rerank.not_yet(rerank.boost(more, "symbols", F.lit(True)), found, ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


DEFINING = "(lang = 'en' or contains(content, '|'))"
NEAR_SQL = f"select vec_id, {distance_sql()} as score from {CHUNKS_SQL} where {{where}} order by score, vec_id limit {K}"
MORE_SQL = f"""with f as ({NEAR_SQL.format(where='true')}), m as ({NEAR_SQL.format(where=DEFINING)})
select vec_id, round(score, 6) as score from f union all select vec_id, round(score * {rerank.BOOSTS['symbols']}, 6) from m where vec_id not in (select vec_id from f)"""


def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the sizes that code and documents have by themselves."""
    n = (300 + F.col("doc_id") % 2000).cast("int")
    name = F.when(F.col("lang") == "fr", "README.md").when(F.col("lang") == "de", "CHANGELOG").otherwise("main.ts")
    f = inputs.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("file_path"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("some words of line "), i.cast("string"))), "\n").alias("content"))
    return chunk.windows(f).select("file_path", "start_line", "end_line")


SIZES_SQL = """with f as (select concat(doc_id, '/', case lang when 'fr' then 'README.md' when 'de' then 'CHANGELOG' else 'main.ts' end) as file_path, 300 + doc_id % 2000 as n, case when lang in ('fr', 'de') then 1024 else 256 end as size, case when lang in ('fr', 'de') then 924 else 206 end as stride from documents),
s as (select *, unnest(range(0, cast(ceil(greatest(n - size, 0) / stride::double) as bigint) * stride + 1, stride)) as st from f)
select file_path, cast(st + 1 as integer) as start_line, cast(least(st + size, n) as integer) as end_line from s"""


def activity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate over a finished table, where the bound on lateness has no effect."""
    e = inputs.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file_path"))
    return ingest.activity(e).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "file_path", "n")


def result_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    kind = F.when(status == "O", "commit").when(status == "F", "pr").otherwise("code")
    merged = F.when(F.col("o_orderpriority").startswith("1"), day + F.expr("interval 3 days"))
    return o.select("o_orderkey", kind.alias("kind"), F.date_format(rerank.result_date(kind, day, merged, day), "yyyy-MM-dd").alias("dated"))


DATES_SQL = """select o_orderkey, case o_orderstatus when 'O' then 'commit' when 'F' then 'pr' else 'code' end as kind,
  strftime(case o_orderstatus when 'O' then o_orderdate when 'F' then o_orderdate + case when starts_with(o_orderpriority, '1') then interval 3 days else interval 0 days end end, '%Y-%m-%d') as dated from orders"""

BASES = Values("base int, intent string, large boolean, override int", tuple((b, i, large, o) for b in (1, 5, 10) for i in ("general", "historical", "debugging") for large in (False, True) for o in (None, 30)))


#: A base for each turn of all conversations.
ASKED = Spread(BASES, "conversations", "conv_id + turn", "conv_id; turn; base; intent; large; override")


def neighbour_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = intent.neighbours(*(F.col(c) for c in ("base", "intent", "large", "override")))
    return ASKED.df(spark, sf_dir).select("conv_id", "turn", "base", "intent", "large", "override", of["code"].alias("code"), of["commit"].alias("commits"), of["pr"].alias("pulls"))


BUDGETS_SQL = f"""with b as (select *, coalesce(override, case when large then 10 else base end) as n, case when intent in ('historical', 'debugging') then 2 else 1 end as h from {ASKED.sql()})
select conv_id, turn, base, intent, large, override, greatest(4 * n, 20)::integer as code, greatest(2 * n * h, 10)::integer as commits, greatest(n * h, 5)::integer as pulls from b"""

ANSWERS = Values("number int, answer string", (
    (1, "file: src/a.ts\nnot a line\nFILE: src/b.ts  \nfile:lib/c.py"), (2, "file: /etc/passwd\nfile: ../up.py\nfile: ok.go"), (3, "nothing"), (4, "".join(f"file: f{i}.ts\n" for i in range(8))), (5, " file: indented.ts\nfile:   spaced.ts"),
))


#: Every document with an answer below it, which names a file of its own too.
REPLIES = Spread(ANSWERS, "documents", "doc_id", "doc_id as id; concat(coalesce(text, ''), chr(10), answer, chr(10), 'file: ', source, '/f', doc_id, '.ts') as answer")


def triage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REPLIES.df(spark, sf_dir).select("id", F.posexplode(engine.triaged(F.col("answer"))).alias("place", "path")).withColumn("place", F.col("place") + 1)


TRIAGE_SQL = f"""with l as (select id, unnest(string_split(answer, chr(10))) as line, generate_subscripts(string_split(answer, chr(10)), 1) as i from {REPLIES.sql()}),
p as (select id, i, trim(substr(line, 6)) as path from l where starts_with(line, 'file:')), r as (select *, cast(row_number() over (partition by id order by i) as integer) as place from p where not starts_with(path, '/') and not contains(path, '..'))
select id, place, path from r where place <= 5"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    store_upserts, store_edges, store_pulls, store_cleared, ann_some_lists, code_symbols, lexed_symbols, code_windows_tagged, code_call_edges, knn_with_symbols, symbol_candidates, window_sizes, activity_windows, result_dates, neighbour_budgets, triage_paths,
)}
SQL = {
    "store_upserts": f"select file_path, start_line, end_line, content_md5 from ({windows_sql(8, 2)}) where file_path in (select file_path from {FILES_SQL} where doc_id % 11 <> 0)",
    "store_edges": EDGE_SQL,
    "store_pulls": "select page_id::integer as pr_number, url as title, case when ends_with(url, '7') or ends_with(url, '3') then 'merged' end as state from pages",
    "store_cleared": CLEARED_SQL,
    "code_symbols": SYMBOLS_SQL,
    "lexed_symbols": LEXED_SQL,
    "code_windows_tagged": TAGGED_SQL,
    "code_call_edges": CALLS_SQL,
    "knn_with_symbols": f"select vec_id, round(score, 6) as score from ({NEAR_SQL.format(where=DEFINING)})",
    "symbol_candidates": MORE_SQL,
    "window_sizes": SIZES_SQL,
    "activity_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, concat('u/', user_id) as file_path, count(*) as n from events group by all",
    "result_dates": DATES_SQL,
    "neighbour_budgets": BUDGETS_SQL,
    "triage_paths": TRIAGE_SQL,
}
