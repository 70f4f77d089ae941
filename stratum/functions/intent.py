"""What a question is after: its intent as a distribution, blended weights, and the time it refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on these lists as they are. Patterns among the words match as plain text unless
# asked for otherwise.
WORDS = {
    "overview": ["about", "overview", "purpose", "project", "feature", "summary", "describe", "explain.*project", "tech.*stack", "stack", "main", "major", "core", "what.*is.*this"],
    "historical": [
        "why", "when", "who", "history", "introduced", "added", "removed", "changed", "motivation", "decision", "context", "background",
        "pr", "pull request", "issue", "ticket", "milestone", "review", "approved", "merged", "linked", "resolved", "goal",
        "roadmap", "planning", "rationale", "trade-?off",
    ],
    "implementation": [
        "how", "implement", "code", "function", "class", "method", "interface", "module", "import", "export", "define",
        "declaration", "signature", "return", "parameter", "type", "architecture", "structure", "pattern", "design", "call",
        "api", "endpoint", "schema", "model", "component", "trace", "flow", "middleware", "chain", "pipeline",
        "dispatch", "route", "handle", "process", "traverse", "walk", "step.*through", "iterator", "next",
    ],
    "debugging": [
        "bug", "fix", "error", "broken", "crash", "fail", "exception", "regression", "revert", "bisect", "blame", "cause", "broke",
        "debug", "stack", "issue", "wrong", "unexpected", "null", "undefined", "timeout", "leak", "corrupt",
        "root.*cause", "broke.*after", "since.*commit",
    ],
}
INTENTS = ["overview", "historical", "implementation", "debugging", "general"]
#: By intent: weights of commits, code and pull requests, share of the budget for code, recency decay.
PROFILES = {
    "overview": (0.6, 1.8, 0.7, 0.70, 0.30),
    "historical": (1.2, 0.8, 1.5, 0.20, 0.00),
    "implementation": (0.8, 1.5, 0.9, 0.80, 0.40),
    "debugging": (1.5, 1.2, 0.7, 0.20, 0.15),
    "general": (1.0, 1.0, 1.0, 0.50, 0.20),
}
BLENDED = ("w_commit", "w_code", "w_pr", "code_ratio", "decay")
TEMPERATURE, FLOOR = 1.5, 0.15
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Questions that ask to follow a flow. Stems that are cut short match as whole words only.
FLOW = (
    r"(?i)\b(how\s+(does|do|did|is|are|will|would|could|can)|affects?|flow|trace|mechan|internal|under.?the.?hood|step.?by.?step"
    r"|calls?\s+chain|propagat|data.?flow|code.?path|walks?.?through|end.?to.?end)\b"
)


def pattern(words: list[str], as_patterns: bool = False) -> str:
    """Whole words in either case."""
    special = set(r".*+?^${}()|[]\\-")
    plain = words if as_patterns else ["".join("\\" + c if c in special else c for c in w) for w in words]
    return r"(?i)\b(?:" + "|".join(plain) + r")\b"


def hits(question: Column, intent: str, as_patterns: bool = False) -> Column:
    return F.regexp_count(question, F.lit(pattern(WORDS[intent], as_patterns)))


def classify(questions: DataFrame, as_patterns: bool = False) -> DataFrame:
    """Adds the counts n_<intent>, the distribution p_<intent>, intent, and the blended weights.

    A softmax over the counts, with a small share of the largest count for the general intent; ties go to the
    intent that is named first. Without any hit the intent is general alone.
    """
    counted = questions.withColumns({f"n_{i}": hits(F.col("question"), i, as_patterns) for i in INTENTS[:4]})
    most = F.greatest(*(F.col(f"n_{i}") for i in INTENTS[:4]))
    raw = {i: F.col(f"n_{i}").cast("double") for i in INTENTS[:4]} | {"general": most * FLOOR}
    e = {i: F.exp((x - most) / TEMPERATURE) for i, x in raw.items()}
    total = sum(e.values())
    probs = counted.withColumn("hit", most > 0).withColumns({f"p_{i}": F.when(most > 0, x / total).otherwise(1.0 if i == "general" else 0.0) for i, x in e.items()})
    ranked = F.array(*(F.col(f"p_{i}") for i in INTENTS))
    chosen = F.element_at(F.array(*map(F.lit, INTENTS)), F.array_position(ranked, F.array_max(ranked)).cast("int"))
    blend = {name: sum(F.col(f"p_{i}") * PROFILES[i][k] for i in INTENTS) for k, name in enumerate(BLENDED)}
    return probs.withColumn("intent", chosen).withColumns(blend).drop("hit")


def anchor(question: Column, now: Column) -> Column:
    """The date that a question refers to, or null. Month and year come first, then so long ago, then the last
    unit, then recency, then a bare year's middle."""
    part = lambda p, i: F.regexp_extract(question, p, i)
    month_year = r"(?i)\b(" + "|".join(MONTHS) + r")\w*\s+(20\d{2})\b"
    ago, last = r"(?i)\b(\d+)\s+(year|month|week|day)s?\s+ago\b", r"(?i)\blast\s+(year|month|week)\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(month_year, 1))).cast("int")
    n, unit = part(ago, 1).try_cast("int"), F.lower(part(ago, 2))
    back = lambda unit, n: F.when(unit == "year", F.add_months(now, -12 * n)).when(unit == "month", F.add_months(now, -n)).when(unit == "week", F.date_sub(now, 7 * n)).when(unit == "day", F.date_sub(now, n))
    return F.coalesce(
        F.when(question.rlike(month_year), F.make_date(part(month_year, 2).try_cast("int"), month, F.lit(15))),
        F.when(question.rlike(ago), back(unit, n)),
        F.when(question.rlike(last), back(F.lower(part(last, 1)), F.lit(1))),
        F.when(question.rlike(r"(?i)\b(recently|recent|lately)\b"), F.add_months(now, -1)),
        F.when(question.rlike(r"\b(20\d{2})\b"), F.make_date(part(r"\b(20\d{2})\b", 1).try_cast("int"), F.lit(7), F.lit(1))),
    )


def wants_synthesis(question: Column) -> Column:
    """Whether the question asks to follow a flow."""
    return question.rlike(FLOW)


CORE_LOOP = r"(?i)\b(next|handle|dispatch|process|route|iterate|middleware|resolver)\b"
CALL = r"\b([a-zA-Z_$][\w$]*)\s*\("
FILE = r"""(?i)(?:^|\s|['"`])((?:[\w.-]+/)+[\w.-]+\.[a-z]{1,4})\b"""


def symbols(question: Column) -> Column:
    """Names called in the question, then words of core loops that are not among them, in lower case."""
    called = F.transform(F.regexp_extract_all(question, F.lit(CALL), F.lit(1)), F.lower)
    words = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(CORE_LOOP), F.lit(1)), F.lower))
    return F.concat(called, F.array_except(words, called))


def mentioned_files(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(FILE), F.lit(1))


def budgets(base: int, intent: str, large: bool = False, override: int | None = None) -> dict[str, int]:
    """How many neighbours to fetch of code, commits and pull requests."""
    b = override or (10 if large else base)
    h = 2 if intent in ("historical", "debugging") else 1
    return {"code": max(4 * b, 20), "commit": max(2 * b * h, 10), "pr": max(b * h, 5)}


def neighbours(base: Column, intent: Column, large: Column, override: Column) -> dict[str, Column]:
    """``budgets`` of many questions; an override of 0 or null is none."""
    b = F.when(F.coalesce(override, F.lit(0)) != 0, override).otherwise(F.when(large, F.lit(10)).otherwise(base))
    h = F.when(intent.isin("historical", "debugging"), F.lit(2)).otherwise(F.lit(1))
    return {"code": F.greatest(4 * b, F.lit(20)), "commit": F.greatest(2 * b * h, F.lit(10)), "pr": F.greatest(b * h, F.lit(5))}
