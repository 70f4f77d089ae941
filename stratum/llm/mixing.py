"""Mixing of sources to target weights by Poisson replication and one global shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import parts, told_apart

#: Hexadecimal digits of a hash that make a number of 52 bits, which a double holds exactly.
DIGITS = 13


@dataclass(frozen=True)
class Params:
    """weights: target share of each source, any positive scale; sources without one share ``other`` by their
    rows. total: rows wanted for each row there is. most: mean repetition of one Poisson quantile, as
    a double can't hold the weights of much higher ones; a higher mean is drawn in parts, whose sum is Poisson too. seed: of all draws. broadcast_rows: sources
    that a broadcast may hold. salts: parts into which each source is dealt if there are more."""

    weights: dict[str, float] = field(default_factory=lambda: {"src0": 0.2, "src1": 0.1, "src2": 0.05})
    other: float = 0.65
    total: float = 1.0
    most: float = 200.0
    seed: int = 17
    broadcast_rows: int = 10_000
    salts: int = 64


def uniform(key: Column, salt: str) -> Column:
    """A number from 0 to under 1 by the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, rate: Column) -> Column:
    """The least k at which the Poisson distribution function of that rate exceeds u, up to a k of no weight."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(u < a.c, a).otherwise(F.struct((a.p * rate / i).alias("p"), (a.c + a.p * rate / i).alias("c"), i.alias("k")))
    return F.aggregate(F.sequence(F.lit(1), furthest(rate)), start, step, lambda a: a.k)


def furthest(rate: Column) -> Column:
    """A count that a Poisson distribution of the rate exceeds with a chance under 2**-52."""
    return F.ceil(rate + 12.0 * F.sqrt(rate) + 30.0).cast("int")


def drawn(key: Column, rate: Column, p: Params) -> Column:
    """A Poisson count of any rate: the sum of independent ones of equal parts of it, none above ``most``, each of a hash of its own.
    The first part's hash is of the key alone."""
    parts = F.greatest(F.lit(1), F.ceil(rate / p.most)).cast("int")
    own = lambda j: uniform(F.when(j == 1, key).otherwise(F.concat(j.cast("string"), F.lit(":"), key)), f"{p.seed}:n:")
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + poisson(own(j), rate / parts))


def rates(docs: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """source, n and the mean repetition that gives each source its share of the rows wanted; the number of sources."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    known = F.create_map(*(F.lit(x) for pair in sorted(p.weights.items()) for x in pair)) if p.weights else F.create_map().cast("map<string,double>")
    weight = known[F.coalesce("source", F.lit(""))].cast("double")
    sizes = sizes.withColumn("weight", weight)
    # one row of totals comes to the driver
    all_ = sizes.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("weight").isNull(), F.col("n"))).alias("rest"), F.sum("weight").alias("given"), F.count("*").alias("sources")).first()
    share = F.coalesce(F.col("weight"), F.lit(p.other) * F.col("n") / F.lit(all_.rest))
    scale = (all_.given or 0.0) + (0.0 if all_.rest is None else p.other)
    return sizes.select("source", "n", (share / F.lit(scale) * F.lit(all_.rows) * p.total / F.col("n")).alias("rate")), all_.sources


def mix(docs: DataFrame, params: Params | None = None, columns: list[str] | None = None, marks: bool = True) -> DataFrame:
    """The documents, each as often as drawn, in a global random order: all or the given columns, then, with ``marks``,
    rate, copy and place.

    A document's count is the Poisson quantile, at its source's rate, of a number hashed from seed and doc_id, or the sum of
    several at equal parts of the rate; so a rerun draws the same, and rows that repeat a doc_id are drawn alike. The one exchange of documents deals
    them out by equal ranges of ``place``, a hash of doc_id and copy, and each part is sorted by it. A source is
    never a key of it: sources are counted with partial sums, and their rates are broadcast while there are at
    most ``broadcast_rows`` of them; beyond that each is dealt into ``salts`` parts and joined by both.

    Null sources are a source of their own, weighted as ""; a null doc_id hashes as ""; null texts stay. Further columns
    stay, whatever their names, also beside columns named like the marks. An empty table gives an empty table.
    """
    p = params or Params()
    names = docs.columns
    docs = told_apart(docs)
    if columns:
        docs = docs.select(*columns)
        names = columns
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    table, sources = rates(docs, p)
    table = table.select(F.col("source").alias("_of"), F.col("rate").alias("_rate"))
    same = F.col("source").eqNullSafe(F.col("_of"))
    if sources <= p.broadcast_rows:
        rated = docs.join(F.broadcast(table), same)
    else:
        dealt = docs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(p.salts)))
        spread = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.salts - 1).cast("long"))))
        rated = dealt.join(spread, same & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")
    copies = rated.withColumn("_count", drawn(key, F.col("_rate"), p)).where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    place = uniform(F.concat(key, F.lit(":"), F.col("_copy").cast("string")), f"{p.seed}:o:")
    n = parts(docs.sparkSession)
    out = copies.withColumn("_place", place).repartitionById(n, F.floor(F.col("_place") * n).cast("int")).sortWithinPartitions("_place", "doc_id", "_copy")
    own = out.select(*docs.columns, *(["_rate", "_copy", "_place"] if marks else []))
    return own.toDF(*names, *(["rate", "copy", "place"] if marks else []))


def oracle(p: Params | None = None) -> str:
    """The same rows in DuckDB's SQL."""
    p = p or Params()
    weights = ", ".join(f"('{k}', {v!r}::double)" for k, v in sorted(p.weights.items()))
    number = lambda text: f"(('0x' || substr(md5({text}), 1, {DIGITS}))::bigint::double / {float(1 << 52)!r}::double)"
    return f"""
with recursive weights(name, weight) as (values {weights}),
sizes as (select source, count(*) as n from documents group by source),
weighed as (select sizes.*, weight from sizes left join weights on name = coalesce(source, '')),
whole as (select sum(n) as rows_, sum(case when weight is null then n end) as rest, coalesce(sum(weight), 0) + case when bool_or(weight is null) then {p.other!r}::double else 0::double end as scale from weighed),
rated as (select source, coalesce(weight, {p.other!r}::double * n::double / rest::double) / scale * rows_::double * {p.total!r}::double / n::double as rate from weighed, whole),
rates as (select source, rate, greatest(1, ceil(rate / {p.most!r}::double))::int as parts, rate / parts as lam from rated),
steps(source, lam, k, p, c) as (
  select source, lam, 0, exp(-lam), exp(-lam) from rates
  union all select source, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) from steps where k < ceil(lam + 12.0::double * sqrt(lam) + 30.0::double)),
numbered as (select row_number() over () as row, d.doc_id, d.lang, d.source, d.n_chars, md5(d.text) as text_md5, r.rate, r.parts, r.lam from documents d join rates r on d.source is not distinct from r.source),
drawn as (select *, unnest(range(1, parts + 1)) as j from numbered),
hashed as (select *, {number(f"'{p.seed}:n:' || case when j = 1 then '' else j::varchar || ':' end || coalesce(doc_id::varchar, '')")} as u from drawn),
part as (select row, (select count(*) from steps s where s.source is not distinct from hashed.source and s.c <= hashed.u and s.k < ceil(lam + 12.0::double * sqrt(lam) + 30.0::double)) as n from hashed),
counted as (select numbered.*, t.n from numbered join (select row, sum(n)::bigint as n from part group by row) t using (row)),
copies as (select counted.*, unnest(range(1, n + 1))::int as copy from counted)
select doc_id, source, lang, n_chars, copy, text_md5, round(rate, 9) as rate, {number(f"'{p.seed}:o:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar")} as place from copies"""


