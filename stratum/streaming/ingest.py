"""Streams of files and commits into the store, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.operators import embed
from stratum.sources import git
from stratum.sources.code import update_code
from stratum.sources.store import Store

FILES = "file_path string, content string, version long"


def latest(batch: DataFrame) -> DataFrame:
    """One row for each file of a batch, the one of the highest version; a null content is a deletion."""
    return batch.groupBy("file_path").agg(F.max_by("content", "version").alias("content"))


def upsert(store: Store, make_embedder=embed.HashedWords):
    """A function for foreachBatch that replaces the chunks, symbols and call edges of the files of a batch. Repeating a batch changes
    nothing, and batches in order leave what one run over the last state of all files does."""

    def run(batch: DataFrame, epoch: int) -> None:
        files = latest(batch).persist()
        try:
            with store.change() as change:
                update_code(change, files.select("file_path"), files.where("content is not null"), make_embedder)
        finally:
            files.unpersist()

    return run


def once(store: Store, table: str, rows: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends each batch to a table exactly once.

    The number of the batch goes into the same version of the store as its rows. A batch that comes again, as the stream was cut
    off after that version and before its own checkpoint, is found there and left out; one that was cut off before left
    no version. Numbers are kept by the id that a stream has from its checkpoint, so a stream that begins anew counts anew.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        with store.change() as change:
            done = dict(change.state.get("batches", {}))
            if done.get(f"{table}:{stream}", -1) >= epoch:
                return
            change.append(table, rows(batch))
            change.state["batches"] = done | {f"{table}:{stream}": epoch}

    return run


def follow_commits(spark: SparkSession, repo: str, store: Store, checkpoint: str, rows: Callable[[DataFrame], DataFrame], page: int = git.PAGE) -> StreamingQuery:
    """Takes the commits that have landed since the last run, or all, into the store, and ends. ``rows`` makes rows of the table of commits
    of a log."""
    log = git.follow_log(spark, repo, page=page)
    return log.writeStream.foreachBatch(once(store, "commits", rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_files(spark: SparkSession, path: str, store: Store, checkpoint: str, per_trigger: int = 100) -> StreamingQuery:
    """Takes JSON lines of files (file_path, content, version) as they appear in a folder, and ends when none are left."""
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_trigger).json(path)
    return stream.writeStream.foreachBatch(upsert(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of changes by window and file of a stream (ts, file_path), with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "file_path").agg(F.count("*").alias("n"))
