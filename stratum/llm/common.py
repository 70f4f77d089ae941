"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch to Python may hold; long documents thus come in small batches.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns, ``alias="type"``, whatever else ``df`` holds.

    Columns are found by exact name and position, so further columns whose names differ in case only,
    or occur twice, do no harm. A missing column is an error that names it.
    """
    places = []
    for name, kind in columns.items():
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        places.append((df.columns.index(name), name, kind))
    renamed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return renamed.select(*(F.col(f"c{i}").cast(kind).alias(name) for i, name, kind in places))


def told_apart(docs: DataFrame) -> DataFrame:
    """The same columns in the same order, those of documents by their names and any other by its place, so that
    names which occur twice or differ in case only don't clash. ``toDF`` of the old names undoes it."""
    own = ("doc_id", "text", "lang", "source", "n_chars")
    first = {docs.columns.index(n) for n in own if n in docs.columns}
    return docs.toDF(*(n if i in first else f"_column{i}" for i, n in enumerate(docs.columns)))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a null text as the empty one."""
    return pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what Spark hands to a Python worker at once, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    on a local master, as in tests, one temporary folder of the session."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="stratum-")
        spark.sparkContext.setCheckpointDir(f"file://{at}")
        at = f"file://{at}"
    return str(at).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Folders of tables that results still read from, to be deleted when the application ends.
LEFT: dict[str, SparkSession] = {}


@atexit.register
def clean() -> None:
    for path, spark in LEFT.items():
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception as e:  # the application ends anyway
            print(f"{path} may be left: {type(e).__name__}")


class Cut:
    """Tables written once to the shared folder, to be read many times and deleted when done with.

    A lost executor loses nothing of them, and later stages start from the table. As a context, it deletes all of its tables
    but ``result`` on leaving, also upon failure. A result is read from as long as the application lasts, and
    deleted when that ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.turn = 0
        LEFT[self.root] = spark

    def __enter__(self) -> Cut:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        for name in list(self.paths):
            if kind or name != "result":
                self.drop(name)

    def result(self, df: DataFrame) -> DataFrame:
        """The table that stays."""
        return self.write(df, "result")

    def write(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """``df`` as a table; an earlier one of that name goes once the new one is there. The shuffle files it came
        from are then of no more use: with ``free``, the driver's garbage is collected at once, upon which Spark deletes
        them, instead of when its memory happens to run short."""
        self.turn += 1
        path = f"{self.root}/{name}-{self.turn}"
        df.write.parquet(path)
        for _ in range(2 if free else 0):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)  # references are let go of by other threads
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if old := self.paths.pop(name, None):
            delete(self.spark, old)


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 500) -> DataFrame:
    """``rows`` with the columns of ``table``, which is written, has a row a key, and says in ``weight`` how many rows have it.

    Keys of ``most`` rows or more, and of a thousandth of all at least, come by a broadcast; that many rows can only be had by a
    thousand keys. So no task of the shuffled rest gets a key with more.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) >= max(most, -(-total // 1000))
    if table.where(hot).isEmpty():
        return rows.join(table, key)
    few = table.where(hot)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def sifted(rows: DataFrame, wanted: DataFrame, key: str, slots: int = 1 << 17) -> DataFrame:
    """``rows`` whose key is among those wanted, or by chance has the bit of one. The bits are 64 a slot, so the broadcast has
    ``slots`` rows at most, whatever is wanted; what a join of wide rows would shuffle for nothing is mostly left out before it."""
    return marked(rows, wanted, key, slots).where("_hit").select(*rows.columns)


def marked(rows: DataFrame, wanted: DataFrame, key: str, slots: int) -> DataFrame:
    """``rows`` with ``_hit``, whether the bit of their key is set."""
    h = F.xxhash64(key)
    slot, bit = F.pmod(F.shiftright(h, 6), F.lit(slots)), F.pmod(h, F.lit(64)).cast("int")
    marks = wanted.select(slot.alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    hit = rows.withColumn("_slot", slot).join(F.broadcast(marks), "_slot", "left")
    set_ = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return hit.withColumn("_hit", F.coalesce(set_, F.lit(False)))


def without(rows: DataFrame, gone: DataFrame, key: str, slots: int = 1 << 17) -> DataFrame:
    """``rows`` whose key is not among those gone, which are distinct. Only rows with the bit of one are joined."""
    every = marked(rows, gone, key, slots)
    # no anti-join, which Spark would move below the marking
    doubted = every.where("_hit").join(gone.select(key, F.lit(True).alias("_gone")), key, "left").where("_gone is null")
    return every.where("not _hit").select(*rows.columns).unionByName(doubted.select(*rows.columns))


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
