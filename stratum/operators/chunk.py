"""Source files into overlapping windows of lines, with a summary and the symbols that each window meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import paths
from stratum.operators.graph import bins, shuffled

CODE, DOCUMENT = (256, 50), (1024, 100)
HEAD, TAIL, LEAST = 80, 40, 20


def dense(content: Column, least: int = LEAST) -> Column:
    """Enough characters other than white space."""
    return F.length(F.regexp_replace(content, r"\s", "")) >= least


def starts(n: Column, size: Column, overlap: Column) -> Column:
    """First lines, from 0, of windows that cover n lines and end with the one that reaches the last."""
    stride = size - overlap
    return F.sequence(F.lit(0), F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int") * stride, stride)


def windows(files: DataFrame, size: Column | int | None = None, overlap: Column | int | None = None, summaries: bool = False) -> DataFrame:
    """file_path, language, start_line, end_line, content, is_summary, content_hash of files (file_path, content).

    Code and documents have windows of their own sizes unless one is given. Windows with hardly any text are left
    out. With ``summaries`` a file of more than a window has a summary too. A row is a file and grows into its
    windows in place, so nothing is shuffled.
    """
    path, doc = F.col("file_path"), paths.is_document(F.col("file_path"))
    size = F.lit(size) if isinstance(size, int) else size if size is not None else F.when(doc, DOCUMENT[0]).otherwise(CODE[0])
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap if overlap is not None else F.when(doc, DOCUMENT[1]).otherwise(CODE[1])
    lined = files.select(path, paths.language(path).alias("language"), F.split("content", "\n", -1).alias("lines"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), size.alias("size"), overlap.alias("overlap")).withColumn("n", F.size("lines"))
    cut = lined.withColumn("start", F.explode(starts(F.col("n"), F.col("size"), F.col("overlap"))))
    end = F.least(F.col("start") + F.col("size"), F.col("n"))
    chunks = cut.select("file_path", "language", (F.col("start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("start") + 1, end - F.col("start")), "\n").alias("content"), F.lit(False).alias("is_summary"), "content_hash")
    chunks = chunks.where(dense(F.col("content")))
    if not summaries:
        return chunks
    heads = lined.where("n > size").select("file_path", "language", F.lit(1).alias("start_line"), F.col("n").alias("end_line"), summary().alias("content"), F.lit(True).alias("is_summary"), "content_hash")
    return heads.unionByName(chunks)


def summary() -> Column:
    """A header, the first and the last lines of (file_path, language, lines, n)."""
    head = F.concat(F.lit("[SUMMARY] File: "), F.col("file_path"), F.lit(" | Language: "), F.col("language"), F.lit(" | "), F.col("n").cast("string"), F.lit(" lines"))
    first, last = F.slice("lines", 1, HEAD), F.slice("lines", F.greatest(F.col("n") - TAIL + 1, F.lit(1)), F.lit(TAIL))
    return F.concat_ws("\n", head, F.lit("--- HEAD ---"), F.array_join(first, "\n"), F.lit("--- TAIL ---"), F.array_join(last, "\n"))


#: What a window is tagged with, by kinds of symbols.
TAGS = {"functions": ("function", "method"), "classes": ("class",), "imports": ("import",), "exports": ("export",)}


def tagged(chunks: DataFrame, symbols: DataFrame, size: int = 256) -> DataFrame:
    """Adds functions, classes, imports and exports: names whose lines overlap the window, in order of occurrence.

    Windows and symbols are dealt into bins of lines, and a pair meets in the first bin that both have. So a file of any
    length is many keys, and no row holds more symbols than its window shows. Texts aren't dealt; tags come to them by place.
    """
    place = ["file_path", "start_line", "end_line"]
    windows = chunks.where(~F.col("is_summary")).select(*place).distinct()
    dealt = windows.select(*place, bins(F.col("start_line"), F.col("end_line"), size).alias("bin"))
    wanted = symbols.where(F.col("kind").isin([k for kinds in TAGS.values() for k in kinds]))
    ranged = wanted.select("file_path", "ord", "kind", "name", F.col("start_line").alias("first"), F.col("end_line").alias("last"), bins(F.col("start_line"), F.col("end_line"), size).alias("bin"))
    overlap = (F.col("first") <= F.col("end_line")) & (F.col("last") >= F.col("start_line"))
    once = F.col("bin") == F.floor(F.greatest("first", "start_line") / size)
    met = dealt.join(shuffled(ranged), ["file_path", "bin"]).where(overlap & once)
    by_window = met.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "name", "first", "last"))).alias("symbols"))
    joined = chunks.join(shuffled(by_window.withColumn("is_summary", F.lit(False))), [*place, "is_summary"], "left")
    names = lambda kinds: F.coalesce(F.transform(F.filter("symbols", lambda s: s.kind.isin(*kinds)), lambda s: s["name"]), F.array().cast("array<string>"))
    return joined.withColumns({tag: names(kinds) for tag, kinds in TAGS.items()}).select(*chunks.columns, *TAGS)
