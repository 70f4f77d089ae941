"""Secret scan: candidates, and how widely each one is owned over the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut, joined as joined_by, pick, small_batches

KINDS = ("assign", "access", "hex", "opaque")
# The three patterns; letters in either case are those of ASCII.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that may be a credential of an unknown maker.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("strong", pa.bool_())])


@dataclass(frozen=True)
class Params:
    """owners, repositories: distinct ones from which on a value is a widely copied example. entropy: least
    bits a character of a live-looking value. owner, repository: columns of documents that name one; a repository lies within its owner,
    here an owner's documents of one language. key: of the hash by which values are known; what
    is written and returned holds no value, and with a key of one's own no guess can be checked against it."""

    owners: int = 3
    repositories: int = 4
    entropy: float = 3.0
    owner: tuple[str, ...] = ("source",)
    repository: tuple[str, ...] = ("source", "lang")
    key: bytes = b"stratum"


def entropy(value: str) -> float:
    counts, n = Counter(value).values(), len(value)
    return math.log2(n) - sum(c * math.log2(c) for c in counts) / n if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) of the three fixed kinds."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]], least: float) -> list[tuple[int, int, int, str]]:
    """Runs with digits and letters and high entropy that overlap no span so far."""
    out = []
    starts = [s[0] for s in taken]
    ends = list(accumulate((s[2] for s in taken), max))  # the furthest end of the spans so far
    for m in OPAQUE.finditer(text):
        if (k := bisect_left(starts, m.end())) and ends[k - 1] > m.start():
            continue
        v = m[0]
        if any(map(str.isdigit, v)) and any(map(str.isalpha, v)) and entropy(v) >= least:
            out.append((m.start(), 3, m.end(), v))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))


def scan(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, owner, repository in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = base_spans(text)
                counts = Counter(k for _, k, _, _ in found)
                digest = hashlib.sha256(joined(found).encode()).hexdigest()
                more = opaque_spans(text, found, p.entropy)
                rows.append((doc_id, owner, repository, counts[0], counts[1], counts[2], digest, [{"kind": KINDS[k], "start": a, "end": e, "secret": hashlib.blake2b(v.encode(), digest_size=20, key=p.key).hexdigest(), "strong": len(v) >= 12 and len(set(v)) >= 6} for a, k, e, v in sorted(found + more)]))
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(FOUND)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return run


SCAN = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind string, start long, end long, secret string, strong boolean>>"


def ownership(found: DataFrame, p: Params) -> DataFrame:
    """secret, uses, repositories, owners, verdict of each distinct value; uses are summed by value, repository and owner
    first, with partial sums, so a task that counts a value's owners has a row for each of its repositories, not one for each use."""
    by = found.groupBy("secret", "owner", "repository").agg(F.sum("uses").alias("uses"), F.max("strong").alias("strong"))
    total = by.groupBy("secret").agg(F.sum("uses").alias("uses"), F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"), F.max("strong").alias("strong"))
    wide = (F.col("owners") >= p.owners) | (F.col("repositories") >= p.repositories)
    return total.withColumn("verdict", F.when(wide, "example").when(F.col("strong"), "live").otherwise("weak"))


def secret_scan(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each document: counts and digest of the base kinds, all spans, and how the values fare over
    the corpus: n_live, n_example, n_weak, and findings (kind, start, end, value's hash, uses, repositories, owners, verdict).

    Values are hashed with a key as soon as they are found; a hash with many distinct owners or repositories is a widely copied example, one of few
    owners that looks random is live, the rest is weak. Base spans always stay. Spans of other high-entropy runs
    (kind opaque) are added where the verdict is live.

    The verdicts come back to each use by ``common.joined``, so the uses of a widely copied example don't meet in one task.

    A null text is empty; an owner or repository with a null column counts as none; repeated rows give a
    row each; empty tables give no rows; clashing columns are ignored.
    """
    p = params or Params()
    spark = docs.sparkSession
    small_batches(spark)
    names = dict.fromkeys(["doc_id", "text", *p.owner, *p.repository])
    named = lambda columns: F.concat(*(x for c in columns for x in (F.col(c), F.lit("\0"))))
    base = pick(docs, **{x: "long" if x == "doc_id" else "string" for x in names}).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), named(p.owner).alias("owner"), named(p.repository).alias("repository"))
    with Cut(spark, "secrets") as cut:
        return cut.result(judged(base, p, cut))


def judged(base: DataFrame, p: Params, cut: Cut) -> DataFrame:
    scanned = cut.write(base.mapInArrow(scan(p), SCAN).withColumn("row", F.monotonically_increasing_id()), "scan")
    # What most documents lack is not exploded.
    one = scanned.select("row", "owner", "repository", F.posexplode("found").alias("at", "f")).select("row", "owner", "repository", "at", "f.secret", "f.strong")
    uses = one.groupBy("secret", "owner", "repository").agg(F.count("*").alias("uses"), F.max("strong").alias("strong"))
    owned = cut.write(ownership(uses, p).withColumnRenamed("uses", "all_uses").drop("strong"), "owned")
    joined_ = joined_by(one.select("row", "at", "secret"), owned, "secret", "all_uses").groupBy("row").agg(F.collect_list(F.struct("at", "secret", F.col("all_uses").alias("uses"), "repositories", "owners", "verdict")).alias("owned"))
    both = scanned.join(joined_, "row", "left")
    owned_ = F.array_sort(F.coalesce("owned", F.array().cast("array<struct<at int, secret string, uses long, repositories long, owners long, verdict string>>")))
    findings = F.transform(F.arrays_zip(F.col("found").alias("f"), owned_.alias("o")), lambda x: F.struct(x.f.kind.alias("kind"), x.f.start.alias("start"), x.f.end.alias("end"), x.o.secret.alias("secret"), x.o.uses.alias("uses"), x.o.repositories.alias("repositories"), x.o.owners.alias("owners"), x.o.verdict.alias("verdict")))
    kept = F.filter(findings, lambda x: (x.kind != "opaque") | (x.verdict == "live"))
    rank = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x.start.alias("s"), rank[x.kind].alias("r"), x.end.alias("e"), x.kind.alias("k")))), lambda y: F.concat_ws(":", y.k, y.s.cast("string"), y.e.cast("string")))
    count = lambda v: F.size(F.filter("findings", lambda x: x.verdict == v)).cast("long")
    return both.withColumn("findings", kept).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(ordered, ",").alias("spans"), count("live").alias("n_live"), count("example").alias("n_example"), count("weak").alias("n_weak"), "findings")
