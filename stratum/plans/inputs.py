"""Inputs of the queries: the driver's tables seen as files, commits, edges and so on, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
NOW_SQL = f"timestamp '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of which much is made that a task gets, about.
DEALT = 20_000
#: Line items of a task that joins them.
ITEMS = 500_000


def dealt(rows: DataFrame, key: str, each: int = DEALT) -> DataFrame:
    """The rows over as many tasks as their number asks for: files of short rows are a task or two, whatever is made of each row."""
    n = -(-rows.count() // each)
    return rows.repartition(n, key) if n > 1 else rows


@dataclass(frozen=True)
class Values:
    """A small literal table: "name type, ..." and rows; the same in Spark and in SQL."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    def sql(self) -> str:
        kinds = [x.split(" ", 1) for x in self.schema.split(", ")]
        of = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}

        def text(v: object) -> str:
            if v is None:
                return "null"
            return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)

        columns = ", ".join(f"cast({n} as {of[k]}) as {n}" for n, k in kinds)
        return f"(select {columns} from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in self.rows)}) t({', '.join(n for n, _ in kinds)}))"


@dataclass(frozen=True)
class Spread:
    """Literal cases dealt over all rows of a given table: each row gets the case of its key, modulo their number, and ``columns``
    are made of both, as expressions that mean the same in Spark's SQL and DuckDB's."""

    cases: Values
    table: str
    key: str
    columns: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        n = len(self.cases.rows)
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(self.cases.rows)], "case_ int, " + self.cases.schema)
        return table(spark, sf_dir, self.table).join(F.broadcast(numbered), F.expr(f"({self.key}) % {n} = case_")).selectExpr(*self.columns.split("; "))

    def sql(self) -> str:
        n = len(self.cases.rows)
        numbered = Values("case_ int, " + self.cases.schema, tuple((i, *r) for i, r in enumerate(self.cases.rows)))
        return f"(select {self.columns.replace('; ', ', ')} from {self.table} join {numbered.sql()} on ({self.key}) % {n} = case_)"


@dataclass(frozen=True)
class Grouped:
    """Literal rows for each row of a given table, whose key is the folder that the paths among them are in."""

    cases: Values
    table: str
    key: str
    paths: tuple[str, ...] = ("file_path",)

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = [x.split(" ", 1) for x in self.cases.schema.split(", ")]
        rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, kinds))) for r in self.cases.rows))
        folder = F.concat(F.lit("g"), F.col(self.key).cast("string"), F.lit("/"))
        each = dealt(table(spark, sf_dir, self.table).select(self.key), self.key).select(folder.alias("folder_"), F.explode(rows).alias("r"))
        return each.select(*(F.concat("folder_", f"r.{n}").alias(n) if n in self.paths else F.col(f"r.{n}") for n, _ in kinds))

    def sql(self) -> str:
        names = [x.split(" ", 1)[0] for x in self.cases.schema.split(", ")]
        return f"(select {', '.join(f'concat(chr(103), {self.key}, chr(47), {n}) as {n}' if n in self.paths else n for n in names)} from {self.table} cross join {self.cases.sql()})"


EXT = {"en": ".ts", "de": ".py", "fr": ".md"}
EXT_SQL = "case lang when 'en' then '.ts' when 'de' then '.py' when 'fr' then '.md' else '.sql' end"
FILES_SQL = f"(select concat(source, '/d', doc_id % 10, '/f', doc_id, {EXT_SQL}) as file_path, text as content, doc_id, lang, source from documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: file_path, content, doc_id, lang, source."""
    ext = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "de", ".py").when(F.col("lang") == "fr", ".md").otherwise(".sql")
    path = F.concat("source", F.lit("/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(path.alias("file_path"), F.col("text").alias("content"), "doc_id", "lang", "source")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of the suppliers' files: hash, date, author, message, file_path.

    Line items are dealt by their orders, so they are shuffled once, and a task sorts and sums up as many of them however large the table.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = dealt(li.select("l_orderkey", "l_suppkey"), "l_orderkey", ITEMS).distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"), F.col("o_orderdate").alias("date"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"),
        F.concat("o_orderpriority", F.lit(" work on "), F.col("o_orderkey").cast("string")).alias("message"), F.concat(F.lit("lib/m"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/s"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("file_path"),
    )


COMMITS_SQL = (
    "(select md5(o_orderkey::varchar) as hash, o_orderdate as date, concat('c', o_custkey) as author, concat(o_orderpriority, ' work on ', o_orderkey) as message, "
    "concat('lib/m', l_suppkey % 7, '/s', l_suppkey, '.ts') as file_path from (select distinct l_orderkey, l_suppkey from lineitem) join orders on l_orderkey = o_orderkey)"
)


def visits(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Events as commits of the users' files: a commit for each hour or day."""
    at = F.date_trunc(unit, "ts")
    return table(spark, sf_dir, "events").select(F.date_format(at, "yyyyMMddHH").alias("hash"), at.alias("date"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file_path"))


def visits_sql(unit: str) -> str:
    return f"(select strftime(date_trunc('{unit}', ts), '%Y%m%d%H') as hash, date_trunc('{unit}', ts)::timestamp as date, concat('u/', user_id) as file_path from events)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls between suppliers' files."""
    li = table(spark, sf_dir, "lineitem")
    f = lambda k: F.concat(F.lit("lib/s"), (k % 40).cast("string"), F.lit(".ts"))
    return li.select(
        f(F.col("l_suppkey")).alias("caller_file"), F.concat(F.lit("f"), (F.col("l_suppkey") % 9).cast("string")).alias("caller_name"),
        F.when(F.col("l_partkey") % 11 == 0, "<external>").otherwise(f(F.col("l_partkey"))).alias("callee_file"), F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("callee_name"), F.col("l_linenumber").cast("int").alias("line"),
    )


EDGES_SQL = (
    "(select concat('lib/s', l_suppkey % 40, '.ts') as caller_file, concat('f', l_suppkey % 9) as caller_name, "
    "case when l_partkey % 11 = 0 then '<external>' else concat('lib/s', l_partkey % 40, '.ts') end as callee_file, concat('f', l_partkey % 9) as callee_name, l_linenumber::integer as line from lineitem)"
)


def chunks(spark: SparkSession, sf_dir: str, vector: bool = True) -> DataFrame:
    """Embeddings with their documents as chunks: vec_id, file_path, source, lang, vector."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("vec_id"), F.col("label")] + [F.col("embedding").alias("vector")] * vector
    return e.select(*cols).join(files(spark, sf_dir), F.col("vec_id") == F.col("doc_id")).drop("doc_id")


CHUNKS_SQL = f"(select vec_id, label, embedding as vector, f.* exclude (doc_id) from embeddings join {FILES_SQL} f on vec_id = doc_id)"


def question(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, which every search has as a literal."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def distance_sql(vector: str = "vector", vec_id: int = 0) -> str:
    return f"list_sum(list_transform(list_zip({vector}, (select embedding from embeddings where vec_id = {vec_id})), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"


ASKED = Values(
    "ask int, question string",
    (
        (1, "hello world"),
        (2, "how does next() dispatch work in lib/router/index.js"),
        (3, "why was auth changed in March 2022?"),
        (4, "what broke after the merge 3 months ago: error in session handling"),
        (5, "overview of the main project features"),
        (6, "market 2022 planning and review history"),
        (7, "fix the crash from last year, revert the regression"),
        (8, "recently added endpoint schema for the api"),
        (9, "who approved pr in 2019 and why"),
        (10, "trace the code flow: how handle() calls process(x) in `src/app.ts` and 'lib/a/b.go'"),
        (11, "what is this"),
        (12, "pull request context, issue and bug with stack"),
        (13, "5 days ago timeout; 2 weeks ago leak"),
    ),
)

#: All turns of all conversations as questions, each after one of the cases.
QUESTIONS = Spread(ASKED, "conversations", "conv_id + turn", "conv_id * 1000 + turn as id; concat(question, ' ', coalesce(text, '')) as question")
