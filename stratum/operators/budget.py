"""Budgets: which expansions, results and messages fit a prompt.

These folds depend on order and skip what doesn't fit, so no running sum expresses them. They run over the few
hundred candidates of one question, in one row's array, never over a table; expansions, which may be any table, go
on in rounds of as many files as could fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROMPT, RESERVE, HEADER, SHARE = 120_000, 10_000, 100, 0.85


def split(ratio: float, prompt: int = PROMPT) -> tuple[int, int, int]:
    """Characters for snippets, for code among them, for commits among them."""
    whole = prompt - RESERVE
    code = int(whole * ratio)
    return whole, code, whole - code


def expansions(files: DataFrame, code_budget: int, key: str = "file_path", order: str = "place", cost: str = "cost") -> DataFrame:
    """Adds ``kept``: files are taken in order as long as the sum stays within its share; one that is too large is
    skipped and the next is tried.

    Any number of files may be given. Each costs ``HEADER`` at least, so of the next files that fit by themselves a
    bounded number, which comes to the driver, fills the share or leaves less of it to the round after."""
    limit, used, kept, last = code_budget * SHARE, 0, [], None
    most = int(limit // HEADER) + 1
    sized = files.select(F.struct(order, key).alias("at"), (F.coalesce(cost, F.lit(0)) + HEADER).cast("long").alias("c"))
    while True:
        rest = sized if last is None else sized.where(F.col("at") > last)
        rows = rest.where(F.col("c") <= limit - used).orderBy("at").limit(most).collect()
        for r in rows:
            if used + r.c <= limit:
                used += r.c
                kept.append(str(r["at"][key]))
        if len(rows) < most:
            break
        kinds = sized.schema["at"].dataType
        last = F.struct(*(F.lit(rows[-1]["at"][n]).cast(kinds[n].dataType).alias(n) for n in (order, key)))
    return files.withColumn("kept", F.coalesce(F.col(key).cast("string").isin(kept), F.lit(False)))


def seeds(candidates: DataFrame, commit_first: bool) -> DataFrame:
    """rank, seed of the first commit and the first code result outside expanded files."""
    first = candidates.where("type = 'commit' or (type = 'code' and not expanded)").groupBy("type").agg(F.min("rank").alias("rank"))
    order = ["commit", "code"] if commit_first else ["code", "commit"]
    return first.select("rank", F.when(F.col("type") == order[0], 0).otherwise(1).alias("seed"))


def fill(candidates: DataFrame, code_budget: int, commit_budget: int, commit_first: bool, used_code: int = 0) -> DataFrame:
    """Candidates (rank, type, cost, expanded, taken) with ``place`` in the order in which they are chosen, or null.

    ``taken`` results stand for expanded files and come first, at no cost of their own; then the seeds, budget or
    not; then the rest by rank. A stream whose share is full skips what doesn't fit, but for the stream that the
    intent favours, which may use what is left of the whole; the fill ends with the first result over the whole.
    """
    whole = code_budget + commit_budget
    seeded = candidates.join(F.broadcast(seeds(candidates, commit_first)), "rank", "left")
    rows = F.array_sort(F.collect_list(F.struct("rank", "type", F.col("cost").cast("long").alias("cost"), "expanded", "taken", "seed")))

    def plus(acc: Column, x: Column, place: bool = True) -> Column:
        code = x.type == "code"
        kept = F.concat(acc.kept, F.array(x["rank"].cast("int"))) if place else acc.kept
        return F.struct((acc.code + F.when(code, x.cost).otherwise(F.lit(0).cast("long"))).alias("code"), (acc.commit + F.when(code, F.lit(0).cast("long")).otherwise(x.cost)).alias("commit"), acc.done.alias("done"), kept.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        code = x.type == "code"
        total = acc.code + acc.commit
        over = total + x.cost > whole
        full = F.when(code, acc.code + x.cost > code_budget).otherwise(acc.commit + x.cost > commit_budget)
        spills = (code & F.lit(not commit_first)) | (~code & F.lit(commit_first))
        skip = acc.done | (code & x.expanded) | F.when(spills, full & over).otherwise(full)
        paid = plus(acc, x, place=False)
        ended = F.struct(paid.code.alias("code"), paid.commit.alias("commit"), F.lit(True).alias("done"), paid.kept.alias("kept"))
        return F.when(skip, acc).when(over & (F.size(acc.kept) > 0), ended).otherwise(plus(acc, x))

    taken, first = F.filter("rows", lambda x: x.taken), F.filter("rows", lambda x: x.seed.isNotNull() & ~x.taken)
    ordered_seeds = F.array_sort(F.transform(first, lambda x: F.struct(x.seed.alias("s"), x.alias("x"))))
    start = F.struct(F.lit(used_code).cast("long").alias("code"), F.lit(0).cast("long").alias("commit"), F.lit(False).alias("done"), F.transform(taken, lambda x: x["rank"].cast("int")).alias("kept"))
    seeded_acc = F.aggregate(ordered_seeds, start, lambda a, y: plus(a, y.x))
    rest = F.filter("rows", lambda x: ~x.taken & x.seed.isNull())
    chosen = seeded.agg(rows.alias("rows")).select(F.aggregate(rest, seeded_acc, step, lambda a: a.kept).alias("kept"))
    places = chosen.select(F.posexplode("kept").alias("place", "rank"))
    return candidates.join(F.broadcast(places), "rank", "left")


def history(messages: DataFrame, spare: int, last: int = 10, by: list[str] | None = None) -> DataFrame:
    """The latest messages (turn, content) of each conversation, ten at most, as far back as they fit together.

    Whether the messages from one on fit is monotone, so a running sum from the latest back is exact.
    """
    back = Window.partitionBy(*(by or [])).orderBy(F.desc("turn"), F.desc("content"))
    sized = messages.withColumn("back", F.row_number().over(back)).where(F.col("back") <= last)
    return sized.withColumn("chars", F.sum(F.length("content")).over(back.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("chars") <= spare)
