"""Texts made of rows: labels, ages, what is embedded, what is drawn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINKED = r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+#(\d+)"
YEAR_MS = 365.25 * 24 * 60 * 60 * 1000
DAY_MS = 86_400_000


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp")).cast("double")


def age_days(ts: Column, now: Column) -> Column:
    return F.floor((millis(now) - millis(ts)) / DAY_MS)


def freshness(ts: Column, now: Column) -> Column:
    days = age_days(ts, now)
    return F.when(days.isNull(), "Unknown").when(days < 180, "Modern").when(days < 540, "Recent").otherwise("Stale")


def relative_age(ts: Column, now: Column) -> Column:
    d = age_days(ts, now)
    count = lambda n, what: F.concat(F.floor(n).cast("string"), F.lit(f" {what} ago"))
    years = F.floor(d / 365)
    return (
        F.when(d.isNull(), "").when(d <= 0, "today").when(d == 1, "yesterday").when(d < 7, count(d, "days")).when(d < 30, count(d / 7, "weeks"))
        .when(d < 365, count(d / 30, "months")).when(years == 1, "1 year ago").otherwise(count(years, "years"))
    )


def decay(ts: Column, now: Column, half_life: float = 365.0) -> Column:
    """One at age zero, half after each half-life."""
    return F.exp(-F.log(F.lit(2.0)) / half_life * F.greatest((millis(now) - millis(ts)) / DAY_MS, F.lit(0.0)))


def linked_issues(body: Column) -> Column:
    """Distinct issue numbers that a text closes, fixes or resolves, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(LINKED), F.lit(1)), lambda x: x.cast("int")))


def diagram_id(s: Column) -> Column:
    """Letters, digits and single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-zA-Z0-9]", "_"), "_+", "_"), "^_|_$", "")


def diagram_label(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, '"', "'"), r"[\[\]]", "")


def listing(tag: str, values: Column, sep: str = ", ") -> Column:
    """A tagged line of values, or null without any."""
    return F.when(F.size(values) > 0, F.concat(F.lit(tag), F.array_join(values, sep)))


def commit_text(hash_: Column, author: Column, date: Column, message: Column, path: Column, others: Column, diff: Column) -> Column:
    """What is embedded of a commit and file."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[COMMIT: "), F.substring(hash_, 1, 8), F.lit("] Author: "), author, F.lit(" | Date: "), date),
        F.concat(F.lit("[MESSAGE]: "), message),
        F.when(path != "", F.concat(F.lit("[FILE]: "), path)),
        listing("[OTHER FILES]: ", others),
        F.when(diff != "", F.concat(F.lit("[DIFF]:\n"), diff)),
    )


def code_text(path: Column, language: Column, start: Column, end: Column, content: Column, functions: Column, classes: Column, imports: Column, exports: Column, summary: Column) -> Column:
    """What is embedded of a chunk; a summary as it is."""
    head = F.concat(F.lit("[CODE] File: "), path, F.lit(" | Language: "), language, F.lit(" | Lines "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(summary, content).otherwise(F.concat_ws("\n", head, listing("[DEFINES] ", F.concat(functions, classes)), listing("[IMPORTS] ", imports), listing("[EXPORTS] ", exports), content))


def pull_text(number: Column, title: Column, state: Column, author: Column, merger: Column, description: Column, issues: Column, merged: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("PR #"), number.cast("string"), F.lit(": "), title),
        F.concat(F.lit("State: "), state, F.lit(" | Author: "), author, F.when(merger != "", F.concat(F.lit(" | Merged by: "), merger)).otherwise("")),
        F.when(description != "", description),
        F.when(issues != "", F.concat(F.lit("Linked issues: "), issues)),
        F.when(merged != "", F.concat(F.lit("Merge commit: "), F.substring(merged, 1, 8))),
    )
