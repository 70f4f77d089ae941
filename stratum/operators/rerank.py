"""Reranking of candidates: intent weights, time, boosts, the way from pull requests to their commits."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import paths, text

RECENCY_YEARS, NEAR_YEARS, NEAR_RATE, MOST = 2.0, 1.5, 0.5, 3.0
BOOSTS = {"overview": 0.5, "symbols": 0.7, "named": 0.4, "mentioned": 0.3, "chained": 1.05}


def result_date(kind: Column, commit: Column, merged: Column, created: Column) -> Column:
    """When a result is from; code is of today and has no date."""
    return F.when(kind == "commit", commit).when(kind == "pr", F.coalesce(merged, created))


def temporal(date: Column, now: Column, anchor: Column, decay: Column) -> Column:
    """The factor by which a result's distance grows with its distance from the anchor, or without one, its age."""
    years = lambda a, b: (text.millis(a) - text.millis(b)) / text.YEAR_MS
    near = 1 + NEAR_RATE * F.least(F.abs(years(date, anchor)) / NEAR_YEARS, F.lit(MOST))
    aged = 1 + decay * F.least(F.greatest(years(now, date), F.lit(0.0)) / RECENCY_YEARS, F.lit(MOST))
    return F.when(date.isNull(), 1.0).when(anchor.isNotNull(), near).when(decay > 0, aged).otherwise(1.0)


def rerank(candidates: DataFrame, now: Column, w_commit: Column, w_code: Column, w_pr: Column, decay: Column, anchor: Column, kind: str = "type", date: str = "date") -> DataFrame:
    """Divides each score by its kind's weight and applies the factor of time; a lower score is better."""
    weight = F.when(F.col(kind) == "commit", w_commit).when(F.col(kind) == "pr", w_pr).otherwise(w_code)
    factor = F.when(F.col(kind) == "code", 1.0).otherwise(temporal(F.col(date), now, anchor, decay))
    return candidates.withColumn("score", F.col("score") / weight * factor)


def ranked(candidates: DataFrame, *ties: str) -> DataFrame:
    """Adds the rank by score. Candidates are a few hundred rows, so one task orders them."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy("score", *ties)))


def boost(candidates: DataFrame, name: str, when: Column) -> DataFrame:
    return candidates.withColumn("score", F.col("score") * F.when(F.coalesce(when, F.lit(False)), BOOSTS[name]).otherwise(1.0))


def documentation(kind: Column, path: Column) -> Column:
    return (kind == "code") & path.rlike(paths.OVERVIEW_PATH)


def names_symbol(functions: Column, content: Column, symbols: list[str]) -> Column:
    """A function of the chunk has one of the names in its own, or the text declares it."""
    if not symbols:
        return F.lit(False)
    lower = F.transform(functions, F.lower)
    any_name = F.exists(lower, lambda f: reduce(or_, (f.contains(s) for s in symbols)))
    return any_name | content.rlike(declares(symbols))


def declares(symbols: list[str]) -> str:
    names = "|".join(s.replace("$", r"\$") for s in symbols)
    return rf"(?i)(?:function\s+(?:{names})\b|(?:var|let|const)\s+(?:{names})\s*=\s*function)"


def mentions(path: Column, files: list[str]) -> Column:
    """The path is one of the files, or ends in one after a slash."""
    return reduce(or_, ((path == f) | path.endswith("/" + f) for f in files), F.lit(False))


def pull_chain(pulls: DataFrame, commits: DataFrame, present: DataFrame, top: int = 3) -> DataFrame:
    """Commits that the best pull requests were merged by and that aren't candidates yet: hash, file_path, score.

    One row for each hash, its first file; the score is the pull request's times a small penalty. ``pulls`` is
    cut to a few rows first, so the prefix join is against a handful and needs no shuffle of the commits.
    """
    best = pulls.where("resolved_by <> ''").orderBy("score", "pr_number").limit(top).select("resolved_by", F.col("score").alias("pr_score"), "pr_number")
    met = commits.join(F.broadcast(best), F.col("hash").startswith(F.col("resolved_by")))  # at most ``top`` rows
    new = met.join(present.select("hash").distinct(), "hash", "left_anti")
    first = Window.partitionBy("hash").orderBy("pr_score", "pr_number", "file_path")
    return new.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("score", F.col("pr_score") * BOOSTS["chained"]).drop("n", "pr_score", "pr_number", "resolved_by")


def not_yet(extra: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates joined by those of another search that aren't among them."""
    return found.unionByName(extra.join(found.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def snippet_chars(kind: Column, message: Column, diff: Column, others: Column, content: Column, title: Column, description: Column, issues: Column) -> Column:
    """About how much of the budget a result takes."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return (
        F.when(kind == "commit", 80 + n(message) + n(diff) + n(F.array_join(others, ", ")))
        .when(kind == "code", 80 + n(content))
        .otherwise(80 + n(title) + F.least(n(description), F.lit(500)) + n(issues))
    )
