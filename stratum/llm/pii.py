"""Personal data: fixed kinds by pattern, more identifiers by bootstrapping over contexts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut, small_batches, texts, told_apart

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number that doesn't match from its first digit doesn't match from a later one either.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: a run with a digit or @, of six characters or more.
SHAPED = re.compile(r"(?<![0-9A-Za-z@+_./#-])[0-9A-Za-z@+_./#-]{6,}")
#: The same, and groups of digits with the blanks and parentheses between them that seeds hold.
GROUPED = re.compile(r"(?<![0-9A-Za-z@+_./#-])(?:(?:\+?[0-9]{1,4}\x20?)?\([0-9]{1,5}\)(?:[\x20.-]?[0-9]+)+|\+?[0-9]+(?:[.-][0-9]+)*(?:\x20[0-9]+(?:[.-][0-9]+)*)+(?![0-9A-Za-z@_/#])|[0-9A-Za-z@+_./#-]{6,})")
WORD = re.compile(r"\w+")
KEY = b"stratum"
#: Characters beside a span in which its context is first sought; if they may cut a word of it, in twice as many.
REACH = 48


@dataclass(frozen=True)
class Params:
    """rounds: of scoring. support: distinct known identifiers that a pattern needs. confidence: least score of
    a pattern, and of an instance, that counts as high. smooth: unknown instances that each pattern is
    taken to have more. broadcast_rows: documents with added spans that a broadcast may hold."""

    rounds: int = 3
    support: int = 3
    confidence: float = 0.75
    smooth: float = 0.5
    broadcast_rows: int = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, in time linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        size = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if size else None
        if m:
            yield at - size, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the four fixed kinds."""
    out = [(a, 0, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") < 256 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def refused(value: str) -> bool:
    """Whether a value has the form of a fixed kind and not what that kind asks for besides: a card's number without its check digit, an
    address with a part over 255, a phone number too short or long. No context makes an identifier of it."""
    digits = sum(c in "0123456789" for c in value)
    if CARD.fullmatch(value) and 14 <= digits <= 19:
        return not luhn(value.replace(" ", "").replace("-", ""))
    return bool((IP.fullmatch(value) and not base_spans(value)) or (PHONE.fullmatch(value) and not 10 <= digits <= 15))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before, one word before, and the words on both sides."""
    reach = REACH
    while len(left := WORD.findall(text[max(0, start - reach) : start])) < 3 and reach < start:
        reach *= 2
    left, reach = [w.lower() for w in left[-2:]], REACH
    while len(right := WORD.findall(text[end : end + reach])) < 2 and end + reach < len(text):
        reach *= 2
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left:
        out.append(f"{left[-1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0].lower()}")
    return out


def known_as(value: str) -> str:
    """What a value goes by in tables: none holds it in clear text, and without the job's key no guess can be checked."""
    return hashlib.blake2b(value.lower().encode(), digest_size=16, key=KEY).hexdigest()


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, "other"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and identifier-shaped runs of each text, both with their contexts; kind is null for the latter."""
    for b in batches:
        rows = []
        for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            spans = base_spans(text)
            counts = Counter(k for _, k, _ in spans)
            found = [{"kind": KINDS[k], "start": a, "end": e, "value": known_as(text[a:e]), "patterns": contexts(text, a, e)} for a, k, e in spans]
            digest = hashlib.sha256(joined([(KINDS[k], a, e) for a, k, e in spans]).encode()).hexdigest()
            if "@" in text or any(c in text for c in "0123456789"):
                starts = [a for a, _, _ in spans]
                ends = list(accumulate((e for _, _, e in spans), max))  # the furthest end of the spans so far
                free = lambda a, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= a
                for m in GROUPED.finditer(text):
                    # groups that touch a known span are looked at one by one
                    for r in [m] if free(m.start(), m.end()) else SHAPED.finditer(text, m.start(), m.end()):
                        v = r[0].rstrip("./#-")
                        a, e = r.start(), r.start() + len(v)
                        if len(v) >= 6 and any(c in v for c in "0123456789@") and free(a, e) and not refused(v):
                            found.append({"kind": None, "start": a, "end": e, "value": known_as(v), "patterns": contexts(text, a, e)})
            rows.append((row, doc_id, xxhash.xxh3_128_hexdigest(text), counts[0], counts[1], counts[2], counts[3], digest, found))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(FOUND)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], ["row", "doc_id", "digest", *(f"n_{k}" for k in KINDS), "base_sha256", "found"])


SCAN = "row long, doc_id long, digest string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind string, start long, end long, value string, patterns array<string>>>"


def bootstrap(edges: DataFrame, known: DataFrame, p: Params, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Patterns and instances of high confidence.

    ``edges`` has distinct (pattern, value); ``known`` the seed values. In each round a pattern scores the sum of
    its instances' scores over their number and ``smooth``; it counts with ``support`` distinct instances of
    full score. An instance that is no seed scores one less the product, over its patterns that count, of one less
    their score. Sums and products are of partial aggregates; each round is written, so its lineage is short.
    """
    scored = cut.write(edges.join(known.withColumn("seed", F.lit(1.0)), "value", "left").withColumn("score", F.coalesce("seed", F.lit(0.0))), "edges")
    for _ in range(p.rounds):
        high = F.col("score") >= p.confidence
        patterns = scored.groupBy("pattern").agg((F.sum(F.when(high, F.col("score")).otherwise(0.0)) / (F.count("*") + p.smooth)).alias("confidence"), F.count_if(high).alias("sure"))
        strong = cut.write(patterns.where((F.col("sure") >= p.support) & (F.col("confidence") >= p.confidence)), "patterns")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("confidence"))))
        instances = cut.write(scored.where("seed is null").join(strong, "pattern").groupBy("value").agg((1.0 - F.exp(doubt)).alias("now")), "instances")
        scored = cut.write(scored.drop("score").join(instances, "value", "left").select("value", "pattern", "seed", F.coalesce("seed", "now", F.lit(0.0)).alias("score")), "edges")
    return strong, instances.where(F.col("now") >= p.confidence)


def find(docs: DataFrame, p: Params, cut: Cut) -> DataFrame:
    """Each document's row number, doc_id, hash of the text, base counts and digest, and accepted spans."""
    small_batches(docs.sparkSession)
    # Row numbers are given once and written; nothing computes them a second time.
    scanned = cut.write(texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(scan, SCAN), "scan")
    one = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    with_patterns = one.select("row", "start", "kind", "value", F.explode("patterns").alias("pattern"))
    edges = with_patterns.select("pattern", "value").distinct()
    known = one.where("kind is not null").select("value").distinct()
    strong, instances = bootstrap(edges, known, p, cut)
    # A span is added where a strong pattern stands around an instance of high confidence. A single word, which may be one that stands
    # before anything, such as "of", only speaks for an instance beside a pattern of two.
    lexical = strong.where(F.size(F.split("pattern", " ")) == 3)
    more = with_patterns.where("kind is null").join(instances.select("value"), "value", "left_semi").join(lexical.select("pattern"), "pattern", "left_semi").select("row", "start").distinct()
    added = more.groupBy("row").agg(F.collect_set("start").alias("added"))
    both = scanned.join(added, "row", "left")
    kept = F.filter("found", lambda x: x.kind.isNotNull() | F.coalesce(F.array_contains("added", x.start), F.lit(False)))
    spans = F.transform(kept, lambda x: F.struct(F.coalesce(x.kind, F.lit("other")).alias("kind"), x.start.alias("start"), x.end.alias("end")))
    return both.select("row", "doc_id", "digest", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind."""
    rank = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate((*KINDS, "other"))) for x in pair))
    order = F.array_sort(F.transform(found, lambda x: F.struct(x.start.alias("s"), rank[x.kind].alias("r"), x.end.alias("e"), x.kind.alias("k"))))
    return F.array_join(F.transform(order, lambda y: F.concat_ws(":", y.k, y.s.cast("string"), y.e.cast("string"))), ",")


def personal_data(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each document: base counts and digest, all spans, and n_other, the spans that bootstrapping adds.

    Seeds are the values of the fixed kinds; the words around them are the patterns, whatever the value's format. What
    travels is the distinct (pattern, value) pairs and row numbers, never texts.

    A null text is empty; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    with Cut(docs.sparkSession, "pii") as cut:
        return cut.result(listing(find(docs, params or Params(), cut)))


def listing(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", listed(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x.kind == "other")).cast("long").alias("n_other"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or what is left of it after an earlier one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def others(found: DataFrame) -> DataFrame:
    """of, digest, more: the spans that bootstrapping adds to each text of a document."""
    more = F.filter("found", lambda x: x.kind == "other")
    return found.where(F.exists("found", lambda x: x.kind == "other")).select(F.col("doc_id").alias("of"), "digest", more.alias("more")).dropDuplicates(["of", "digest"])


def redact(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents with personal data replaced and n_chars, where there is such a column, counted anew.

    The fixed kinds are found again in place. Spans that bootstrapping adds come by doc_id and hash of the text,
    as a broadcast while they are at most ``broadcast_rows``, beyond that by a shuffled join. A null text stays
    null; rows that repeat stay and are redacted alike.
    """
    p = params or Params()
    with Cut(docs.sparkSession, "pii") as cut:
        spans = cut.result(others(find(docs, p, cut)))
    count = spans.count()
    names, docs = docs.columns, told_apart(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            extra = b.schema.get_field_index("added_by_digest")
            out = []
            for i, text in enumerate(b.column(at).to_pylist()):
                if text is not None:
                    added = (b.column(extra)[i].as_py() if extra >= 0 else None) or []
                    digest = xxhash.xxh3_128_hexdigest(text) if added else ""
                    own = next((x["more"] for x in added if x["digest"] == digest), [])
                    text = redacted(text, [(a, e, KINDS[k]) for a, k, e in base_spans(text)] + [(x["start"], x["end"], x["kind"]) for x in own])
                out.append(text)
            columns = {"text": pa.array(out, pa.string())}
            if "n_chars" in schema.names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([columns.get(n, b.column(i)) for i, n in enumerate(schema.names)], schema.names)

    if count:
        by_doc = spans.groupBy("of").agg(F.collect_list(F.struct("digest", "more")).alias("added_by_digest"))
        docs = docs.join(F.broadcast(by_doc) if count <= p.broadcast_rows else by_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    return docs.mapInArrow(run, schema).toDF(*names)
