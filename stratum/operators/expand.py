"""From hits to files: which files are shown whole, which of their chunks, and how."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators import rerank

DECLARED = r"(?:function\s+([a-zA-Z_$][\w$]*)|\b(?:var|let|const)\s+([a-zA-Z_$][\w$]*)\s*=\s*function)\b"
ASSIGNED = r"(?:proto|exports|module\.exports)\.\s*([a-zA-Z_$][\w$]*)\s*=\s*function\b"


def best_per_file(candidates: DataFrame, n: int, *ties: str) -> DataFrame:
    """The best code candidate of each file, for the n best files, with their place."""
    own = candidates.where("type = 'code'")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("score", *ties))).where("_n = 1").drop("_n")
    return first.orderBy("score", "file_path").limit(n).withColumn("place", F.row_number().over(Window.orderBy("score", "file_path")))


def files_to_expand(top: DataFrame, anchors: DataFrame | None, mentioned: DataFrame | None) -> DataFrame:
    """file_path, place: the top files, then anchors, then mentioned files that aren't there yet. Each input is (file_path, place)."""
    parts = [d.select("file_path", F.lit(i).alias("part"), "place") for i, d in enumerate((top, anchors, mentioned)) if d is not None]
    every = reduce(DataFrame.unionByName, parts)
    once = every.groupBy("file_path").agg(F.min(F.struct("part", "place")).alias("p"))
    return once.select("file_path", F.row_number().over(Window.orderBy("p", "file_path")).alias("place"))


def anchors(degrees: DataFrame, n: int = 3) -> DataFrame:
    """The files of most edges."""
    return degrees.orderBy(F.desc("degree"), "file_path").limit(n).select("file_path", F.row_number().over(Window.orderBy(F.desc("degree"), "file_path")).alias("place"))


def mentioned(files: DataFrame, names: list[str]) -> DataFrame:
    """The first file by path for each name in a question, equal or with it at the end."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")
    met = files.select("file_path").distinct().join(F.broadcast(wanted), (F.col("file_path") == F.col("name")) | F.col("file_path").endswith(F.concat(F.lit("/"), F.col("name"))))  # a handful of names
    return met.groupBy("place").agg(F.min("file_path").alias("file_path")).select("file_path", "place")


def chunk_functions(functions: Column, content: Column) -> Column:
    """Names of functions by metadata and by what the text declares, lower-cased, once each in order."""
    found = [F.regexp_extract_all(content, F.lit(DECLARED), F.lit(i)) for i in (1, 2)]
    declared = F.filter(F.transform(F.arrays_zip(found[0].alias("a"), found[1].alias("b")), lambda x: F.when(x.a != "", x.a).otherwise(x.b)), lambda x: x != "")
    assigned = F.regexp_extract_all(content, F.lit(ASSIGNED), F.lit(1))
    return F.array_distinct(F.transform(F.concat(functions, declared, assigned), F.lower))


def has_name(names: Column, wanted: Column) -> Column:
    """One of the names is the wanted one or has it within."""
    return F.exists(names, lambda n: n.contains(wanted))


def context(chunks: DataFrame, symbols: list[str]) -> DataFrame:
    """Adds ``forced``: chunks with a sought symbol, and those before and after without a break that have its parent.

    The parent of a chunk with a symbol is its first function that is no symbol, else its first. Runs of chunks
    that have a parent are islands: a count of the chunks without it, along the file, is the same within a run.
    Each file's chunks are numbered once; parents are few.
    """
    if not symbols:
        return chunks.withColumn("forced", F.lit(False))
    is_symbol = lambda n: reduce(or_, (n.contains(s) for s in symbols))
    named = chunks.withColumn("names", chunk_functions(F.col("functions"), F.col("content")))
    named = named.withColumn("hit", F.exists("names", is_symbol) | F.col("content").rlike(rerank.declares(symbols)))
    others = F.filter("names", lambda n: ~is_symbol(n))
    named = named.withColumn("parent", F.when(F.col("hit"), F.coalesce(F.get(others, F.lit(0)), F.get("names", F.lit(0)))))
    parents = named.where("parent is not null").select("file_path", F.col("parent").alias("p")).distinct()
    along = Window.partitionBy("file_path", "p").orderBy("start_line")
    walked = named.select("file_path", "start_line", "names", "parent").join(parents, "file_path").withColumn("has", has_name(F.col("names"), F.col("p")) | F.coalesce(F.col("parent") == F.col("p"), F.lit(False)))
    island = walked.withColumn("island", F.sum(F.when(F.col("has"), 0).otherwise(1)).over(along)).where("has")
    whole = Window.partitionBy("file_path", "p", "island")
    forced = island.withColumn("from_hit", F.max(F.coalesce(F.col("parent") == F.col("p"), F.lit(False))).over(whole)).where("from_hit").select("file_path", "start_line").distinct().withColumn("walked", F.lit(True))
    return named.join(forced, ["file_path", "start_line"], "left").withColumn("forced", F.col("hit") | F.coalesce("walked", F.lit(False))).drop("names", "hit", "parent", "walked")


def skeleton() -> Column:
    """One line in place of a chunk: its lines and symbols."""
    mark = lambda tag, c, end="": F.transform(c, lambda x: F.concat(F.lit(tag), x, F.lit(end)))
    joined = lambda tag, c: F.when(F.size(c) > 0, F.array(F.concat(F.lit(tag), F.array_join(c, ", ")))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(mark("fn ", F.col("functions"), "()"), mark("class ", F.col("classes")), joined("imports: ", F.col("imports")), joined("exports: ", F.col("exports")))
    lines = F.concat(F.lit("// --- Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    count = (F.col("end_line") - F.col("start_line") + 1).cast("string")
    return F.when(F.size(all_) > 0, F.concat(lines, F.lit(": "), F.array_join(all_, " | "), F.lit(" ---"))).otherwise(F.concat(lines, F.lit(" ("), count, F.lit(" lines) ---")))


def rendered(chunks: DataFrame, hits: DataFrame, cap: int, forced: str | None = None) -> DataFrame:
    """file_path, text of each file: chunks that were hit in full, the others as one line, cut at ``cap`` characters.

    ``hits`` has (file_path, start_line). A file's chunks are bounded by the file.
    """
    flagged = chunks.where(~F.col("is_summary")).join(hits.select("file_path", "start_line").distinct().withColumn("was_hit", F.lit(True)), ["file_path", "start_line"], "left")
    full = F.coalesce("was_hit", F.lit(False)) | (F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False))
    parts = flagged.withColumn("part", F.when(full, F.col("content")).otherwise(skeleton()))
    whole = parts.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "part"))), lambda x: x.part), "\n").alias("text"))
    return whole.withColumn("text", F.when(F.length("text") > cap, F.concat(F.substring("text", 1, cap), F.lit("\n... [file truncated]"))).otherwise(F.col("text")))


def limits(intent: str) -> tuple[int, int]:
    """How many files are expanded, and up to how many characters each."""
    return (3, 8000) if intent in ("historical", "debugging") else (5, 18_000)
