"""Diffs: split by file, condensed to a budget, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = r"^(diff --git|---|\+\+\+|@@|\+|-)"
CUT = "... [diff truncated]"


def by_file(commits: DataFrame, diff: str = "diff") -> DataFrame:
    """A row for each file of a diff, with file_path, place and raw_diff; what stands before the first is left out."""
    parts = commits.select("*", F.posexplode(F.split(diff, r"(?m)(?=^diff --git )")).alias("place", "raw_diff")).where(F.col("raw_diff").startswith("diff --git"))
    path = F.regexp_extract("raw_diff", r"(?m)^diff --git a/.+ b/(.+)$", 1)
    return parts.withColumn("file_path", path).where("file_path <> ''")


def condensed(raw: Column, budget: Column) -> Column:
    """The lines that tell of changes, as many as fit the budget with their ends, and a mark if some don't.

    What fits is a prefix, so one fold over the lines with their running length is exact.
    """
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        used = acc.used + F.length(line) + 1
        over = used > budget
        return (
            F.when(acc.full, acc)
            .when(over, F.struct(acc.used.alias("used"), F.lit(True).alias("full"), F.concat(acc.kept, F.array(F.lit(CUT))).alias("kept")))
            .otherwise(F.struct(used.alias("used"), F.lit(False).alias("full"), F.concat(acc.kept, F.array(line)).alias("kept")))
        )

    return F.aggregate(F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(KEPT)), start, step, lambda acc: F.array_join(acc.kept, "\n"))


def contents(log: DataFrame, stat: str = "stat") -> DataFrame:
    """Adds insertions, deletions and lines_changed from the summary line of a log with statistics."""
    count = lambda word: F.coalesce(F.regexp_extract(stat, rf"(\d+) {word}", 1).try_cast("long"), F.lit(0).cast("long"))
    return log.withColumns({"insertions": count("insertion"), "deletions": count("deletion")}).withColumn("lines_changed", F.col("insertions") + F.col("deletions"))
