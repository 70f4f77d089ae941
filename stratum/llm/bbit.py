"""Near-duplicate detection by b-bit MinHash signatures, with every link confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut, joined, parts, sifted, small_batches, texts, told_apart, without
from stratum.llm.components import components


@dataclass(frozen=True)
class Params:
    """words of a shingle; percent: least similarity of a link. bands of rows minima each give candidates. bits
    of each minimum stay in a signature. margin: standard errors by which an estimate may lie below the threshold
    and still be confirmed. bucket: members up to which buckets with the same members in several bands are told.
    block: shingles of a bucket's members that a part holds, about; see near_duplicates."""

    words: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    bits: int = 8
    margin: float = 5.0
    bucket: int = 64
    block: int = 1_000_000
    seed: int = 9

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def shingles(text: str, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words, ascending; of all words together if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    join = b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + n])) for i in range(len(words) - n + 1)), np.uint64, len(words) - n + 1))


def multipliers(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 31, p.minima, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, p.minima, np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(mul), np.uint32(0xFFFFFFFF))
    for i in range(0, len(folded), 256):
        x = folded[i : i + 256, None] * mul + add
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, x.min(0))
    return least


def signed(p: Params):
    """doc_id, size of the set, a hash of the whole set, the packed low bits of the minima, the bands' keys."""
    mul, add = multipliers(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text, p.words)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None))
                    continue
                least = minima(s, mul, add)
                low = (least & np.uint32((1 << p.bits) - 1)).astype(np.uint8)
                keys = [xxhash.xxh3_64_intdigest(least[i * p.rows : (i + 1) * p.rows].tobytes(), i) - (1 << 63) for i in range(p.bands)]
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), pack_bits(low, p.bits), keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["doc_id", "n_shingles", "whole", "signature", "keys"])

    return run


SIGNED = "doc_id long, n_shingles long, whole binary, signature binary, keys array<long>"


def pack_bits(low: np.ndarray, bits: int) -> bytes:
    """The low bits of each minimum, one after the other."""
    return low.tobytes() if bits == 8 else np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes()


def estimates(one: np.ndarray, many: np.ndarray, p: Params) -> np.ndarray:
    """Similarity of a packed signature to others: matching minima by bit counts, less chance collisions.

    Two minima that differ agree in b bits with chance 2**-b, so the share of matches is J + (1 - J) / 2**b.
    """
    x = one ^ many
    if p.bits == 8:
        same = (x == 0).sum(1)
    else:
        lanes = np.unpackbits(x, axis=1)[:, : p.minima * p.bits].reshape(len(x), p.minima, p.bits)
        same = (lanes.sum(2) == 0).sum(1)
    chance = 2.0**-p.bits
    return (same / p.minima - chance) / (1 - chance)


def least_estimate(p: Params) -> float:
    j = p.percent / 100
    return j - p.margin * (j * (1 - j) / p.minima) ** 0.5


def linked(p: Params):
    """(a, b) of links that join a bucket's members, for rows (key, part, band, id, label, side, signature, keys,
    hashes) in order of key and part.

    A member meets those of other components that share no lower band with it, so a pair meets once over all
    bands, and whose estimate isn't clearly below the threshold. Their whole sets are compared at once by the
    bucket's own index from shingles to members. A link joins components, and members of one component need no
    further comparison; so at most as many links as members leave a bucket, however many pairs are alike.
    """
    least = least_estimate(p)

    def bucket(band: int, ids: np.ndarray, labels: list[int], side: np.ndarray, sig: np.ndarray, keys: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        n, out = len(ids), []
        names, root = np.unique(np.array(labels), return_inverse=True)
        if len(names) == 1:
            return out
        sizes = np.array([len(x) for x in sets])
        starts = order = None
        for i in range(n):
            other = np.flatnonzero(root != root[i])
            other = other[(other > i) & ((side[other] != side[i]) | (side[i] == 2))] if len(other) else other
            if not len(other):
                continue
            other = other[estimates(sig[i], sig[other], p) >= least]
            other = other[(keys[other] == keys[i]).argmax(1) == band] if len(other) else other
            if not len(other):
                continue
            if len(other) <= 16:
                shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other])
            else:
                if order is None:
                    flat = np.concatenate(sets)
                    of = np.repeat(np.arange(n), sizes)
                    order = np.argsort(flat, kind="stable")
                    flat, of = flat[order], of[order]
                low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                shared = np.bincount(np.concatenate([of[a:b] for a, b in zip(low, high)]), minlength=n)[other]
            good = other[100 * shared >= p.percent * (sizes[i] + sizes[other] - shared)]
            for j in good:
                if root[i] != root[j]:
                    out.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                held.sort(key=lambda r: r[1])
                bands, ids, labels, sides, sigs, keys, sets = zip(*held)
                pairs = bucket(bands[0], np.array(ids), list(labels), np.array(sides), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1), np.array(keys), [np.frombuffer(x, np.uint64) for x in sets])
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, part, *row in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (key, part) != at:
                    yield from flush()
                    at, held = (key, part), []
                held.append(row)
        yield from flush()

    return run


def buckets_of(classes: DataFrame, p: Params, cut: Cut) -> DataFrame:
    """key, band, id, n and the size, in members and shingles, of the bands' buckets with two members at least. Of small buckets that have
    the very same members in several bands only the one of the lowest band is kept."""
    keyed = classes.select("id", "n", F.posexplode("keys").alias("band", "key"))
    shared = cut.write(keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1"), "shared")
    every = cut.write(joined(sifted(keyed, shared, "key"), shared, "key", "size"), "keyed")
    cut.drop("shared")
    lists = every.where(F.col("size") <= p.bucket).groupBy("key", "band", "size", "weight").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))
    once = lists.groupBy("ids").agg(F.min(F.struct("band", "key", "size", "weight")).alias("b")).select("b.key", "b.band", F.explode("ids").alias("m"), "b.size", "b.weight").select("key", "band", "m.id", "m.n", "size", "weight")
    out = cut.write(every.where(F.col("size") > p.bucket).select("key", "band", "id", "n", "size", "weight").unionByName(once), "buckets")
    cut.drop("keyed")
    return out


def blocks(weight: Column, p: Params) -> Column:
    """Blocks of about ``block`` shingles."""
    return F.greatest(F.lit(1), F.ceil(weight / p.block)).cast("long")


def spread(count: Column) -> Column:
    return F.pmod(F.xxhash64("id"), count)


def all_of(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count - 1)


def dealt(rows: DataFrame, p: Params) -> DataFrame:
    """Adds ``part`` and ``side``: a bucket is dealt into blocks by id, each with the bucket's smallest member."""
    count = blocks(F.col("weight"), p)
    part = F.when(F.col("id") == F.col("least"), all_of(count)).otherwise(F.array(spread(count)))
    return rows.withColumn("part", F.explode(part)).withColumn("side", F.lit(2)).drop("least")


def crossed(rows: DataFrame, p: Params) -> DataFrame:
    """Adds ``part`` and ``side`` to rows that say whether they roam and how much does: each block of members that don't (side 0)
    meets each block of those that do (1), and each block of the latter meets each other (2). So every pair of
    which one roams is in a part, and a part is two blocks, however many roam."""
    stay, roam = blocks(F.col("weight") - F.col("roaming"), p), blocks(F.col("roaming"), p)
    cell = lambda i, j: i * F.lit(1 << 24) + j
    place = lambda part, side: F.struct(part.alias("part"), F.lit(side).alias("side"))
    own = spread(roam)
    staying = F.transform(all_of(roam), lambda j: place(cell(spread(stay), j), 0))
    meeting = F.transform(all_of(stay), lambda i: place(cell(i, own), 1))
    among = F.transform(all_of(roam), lambda j: place(F.lit(1 << 48) + cell(F.least(j, own), F.greatest(j, own)), 2))
    cells = F.when(F.col("roams"), F.concat(meeting, among)).otherwise(staying)
    return rows.withColumn("c", F.explode(cells)).select(*rows.columns, "c.part", "c.side").drop("roams", "roaming")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    1. Each document gives its set's size, a hash of the whole set, a b-bit signature and its bands' keys.
    2. Documents of equal sets form a class, by partial minima; only one of a class goes on. So any number of copies costs
       no more than one of them.
    3. Classes that share a band's key meet in a bucket. There, pairs whose estimate, corrected for chance
       collisions, is not clearly below the threshold are confirmed on whole sets, which are made anew for the
       members of such buckets only. A bucket gives the links that join its members, never all its pairs.
    4. A bucket of over ``block`` shingles is dealt into blocks, each with the smallest member. Once the links of the
       blocks have joined components, the members outside the bucket's largest component are compared with all others,
       in parts of two blocks, so that each pair of different components is compared and no task holds a bucket.

    Null, empty and blank texts have no set and are linked with nothing, as is a null doc_id. Rows that repeat a
    doc_id all stay and share its component, which the links of all their texts join. An empty table gives no rows; further
    columns are ignored.
    """
    p = params or Params()
    small_batches(docs.sparkSession)
    with Cut(docs.sparkSession, "near") as cut:
        return cut.result(components_of(texts(docs), p, cut))


def components_of(base: DataFrame, p: Params, cut: Cut) -> DataFrame:
    spark = base.sparkSession
    signatures = cut.write(base.mapInArrow(signed(p), SIGNED), "signed")
    usable = signatures.where("whole is not null and doc_id is not null")
    same = usable.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.min(F.struct("n_shingles", "signature", "keys")).alias("s"))
    # a class is known by a number, as one doc_id may stand first in several
    classes = cut.write(same.select(F.xxhash64("whole").alias("id"), "whole", "rep", "rows", F.col("s.n_shingles").alias("n"), "s.signature", "s.keys"), "classes")
    members = joined(usable.select("doc_id", "whole"), classes.where("rows > 1").select("whole", "rep", "rows"), "whole", "rows").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    buckets = buckets_of(classes, p, cut)
    ids = cut.write(buckets.select("id").distinct(), "ids")
    own = sets_of(base, cut.write(sifted(classes, ids, "id").join(ids, "id"), "met"), p)

    def links(rows: DataFrame) -> DataFrame:
        full = rows.join(own, "id").select("key", "part", "band", "id", "label", "side", "signature", "keys", "hashes")
        return full.repartition(parts(spark), "key", "part").sortWithinPartitions("key", "part").mapInArrow(linked(p), "a long, b long").distinct()

    rows = buckets.withColumn("label", F.col("id"))
    large = rows.where(F.col("weight") > p.block)
    least = large.groupBy("key").agg(F.min("id").alias("least"))
    found = cut.write(links(dealt(rows.join(least, "key", "left"), p)), "links")
    if not large.isEmpty():
        labels = components(found, cut, "first")
        named = large.drop("label").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        by_label = named.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
        common = by_label.groupBy("key").agg(F.max_by(F.struct("label", "w"), F.struct("m", "label")).alias("c"), F.sum("w").alias("all_"), F.count("*").alias("labels")).where("labels > 1")
        roaming = named.join(common.select("key", F.col("c.label").alias("common"), (F.col("all_") - F.col("c.w")).alias("roaming")), "key").withColumn("roams", F.col("label") != F.col("common")).drop("common")
        found = found.unionByName(cut.write(links(crossed(roaming, p)), "more"))
    # back from classes to the documents that stand for them
    rep = lambda name: classes.select(F.col("id").alias(name), F.col("rep").alias(f"rep_{name}"))
    between = found.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    final = components(members.unionByName(between), cut, "final")
    out = signatures.select("doc_id", "n_shingles").join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    own_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), own_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def sets_of(base: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """id, signature, keys and the whole set, as bytes, of classes. Sets are dealt by id, so they aren't shuffled again to be joined by it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t, p.words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()), pa.array(made, pa.binary())], ["rep", "whole", "hashes"])

    ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    # no semi-join, which Spark would move below the sifting
    wanted = sifted(base, ids, "doc_id").join(ids, "doc_id").select("doc_id", "text")
    # rows of one id have the same set, whichever row of a repeated doc_id it was made of
    made = wanted.mapInArrow(sets, "rep long, whole binary, hashes binary").select(F.xxhash64("whole").alias("id"), "hashes")
    once = made.repartition(parts(base.sparkSession), "id").dropDuplicates(["id"])
    return once.join(classes.select("id", "signature", "keys"), "id")


def one_of_each(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents without those that are linked to one of a smaller doc_id, with all their columns.

    Documents without words all stay, as does a null doc_id. Of rows that repeat a kept doc_id and have the same
    words in the same order, one stays; unlike ones all do. An empty table gives an empty table; columns of any name and type
    are kept.
    """
    gone = near_duplicates(docs, params).where(~F.col("kept")).select("doc_id").distinct()
    names, docs = docs.columns, told_apart(docs)
    left = without(docs, gone, "doc_id")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():
        lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = F.md5(F.trim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " ")).cast("binary"))
        once = left.join(again, "doc_id", "left_semi").withColumn("_words", words).dropDuplicates(["doc_id", "_words"])
        left = left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return left.select(*docs.columns).toDF(*names)
