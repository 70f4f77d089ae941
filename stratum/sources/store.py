"""The store: versions of Parquet tables of commits, chunks, pull requests and edges, with their maintenance.

Data folders are written once and never changed. A change writes new ones beside those in use, and then makes a version that
names the folders of every table, so readers keep what they have opened, and data and state change together or not at all.
Tables of files are bucketed by a hash of the path, so an upsert rewrites only the buckets that its files fall into.
"""

from __future__ import annotations

import time
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum import schemas
from stratum.sources.versions import Conflict, Versions

__all__ = ["Change", "Conflict", "Store", "changes"]

HASHES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("content_hash", T.StringType())])
TABLES = {"commits": schemas.COMMITS, "code_files": schemas.CHUNKS, "pr_data": schemas.PULLS, "call_graph": schemas.EDGES, "file_hashes": HASHES, "symbols": schemas.SYMBOLS}
#: Tables whose rows are dealt into buckets by file.
BUCKETED = {"code_files", "symbols"}


class Store:
    """Tables under a root folder of any file system that Spark reaches and that renames folders atomically. Missing tables read as empty ones.

    A store that is opened changes nothing, whoever else is at work on it. ``version`` pins it to an earlier state.
    ``buckets`` is what a table of files starts with; it is doubled as often as need be for buckets of at most
    ``bucket_bytes`` on average.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, version: int | None = None, bucket_bytes: int = 128 << 20) -> None:
        self.spark, self.root, self.buckets, self.bucket_bytes = spark, root.rstrip("/"), buckets, bucket_bytes
        self.versions, self.pinned = Versions(spark, root), version

    def version(self) -> int:
        return self.versions.latest() if self.pinned is None else self.pinned

    def contents(self) -> dict:
        return self.versions.contents(self.version())

    def exists(self, name: str) -> bool:
        return name in self.contents()["tables"]

    def parts(self, name: str) -> list[str]:
        """The folders, below the root, that a table consists of."""
        return folders(self.contents(), name)

    def read(self, name: str) -> DataFrame:
        """The table as it is now. The result stays as it is, whatever is written later, until ``vacuum`` takes its version away."""
        return self.rows(name, self.parts(name))

    def rows(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{p}" for p in parts))

    def change(self) -> Change:
        """A context in which tables and state are changed together: they become a version on leaving, and leave no trace upon failure.
        Raises Conflict there if another writer has made one in between."""
        return Change(self)

    # Changes of one step

    def create(self, name: str, df: DataFrame) -> None:
        """Replaces the table."""
        with self.change() as c:
            c.create(name, df)

    def append(self, name: str, df: DataFrame) -> None:
        with self.change() as c:
            c.append(name, df)

    def replace_files(self, paths: DataFrame, chunks: DataFrame | None = None) -> None:
        """Deletes the chunks of the files in ``paths`` (file_path) and adds the given ones, in the touched buckets only."""
        with self.change() as c:
            c.replace_files(paths, chunks)

    def upsert_pulls(self, new: DataFrame) -> None:
        """Adds pull requests; of several versions of one the new one stays."""
        with self.change() as c:
            c.upsert_pulls(new)

    def set_edges(self, edges: DataFrame) -> None:
        """Replaces the edges, unless there are none."""
        if not edges.isEmpty():
            self.create("call_graph", edges)

    def save_hashes(self, hashes: DataFrame) -> None:
        """file_path, content_hash of the files as they were indexed; a table, however many files there are."""
        self.create("file_hashes", hashes)

    def load_hashes(self) -> DataFrame:
        return self.read("file_hashes")

    def save_state(self, **values: object) -> None:
        with self.change() as c:
            c.state.update(values)

    def load_state(self) -> dict:
        """Small facts about the last run, of the same version as the tables."""
        return self.contents()["state"]

    def clear(self) -> None:
        """An empty version; everything else goes from the disk at once."""
        with self.change() as c:
            c.contents.update(tables={}, state={}, indexes={})
            c.changed = True
        self.vacuum(keep=1, grace=0)

    def vacuum(self, keep: int = 3, grace: int = 86_400) -> None:
        """Takes away all but the last ``keep`` versions, and folders that none of these names. A folder younger than ``grace`` seconds
        may be one that a writer is about to name, and stays."""
        v = self.versions
        kept = v.all()[-keep:]
        named = {p for i in kept for p in every_folder(v.contents(i))}
        before = time.time() - grace
        for number in v.all():
            if number < kept[0]:
                v.delete(f"versions/{number}")
        for name, at in v.names("versions"):
            if not name.isdigit() and at <= before:
                v.delete(f"versions/{name}")
        for name, at in v.names("data"):
            whole = f"data/{name}"
            if whole in named or at > before:
                continue
            inner = [f"{whole}/{x}" for x, _ in v.names(whole) if x.startswith("bucket=")]
            if not any(x in named for x in inner):
                v.delete(whole)
                continue
            for x in inner:
                if x not in named:
                    v.delete(x)

    def status(self) -> DataFrame:
        return status(self.read("commits"), self.read("code_files"), self.read("pr_data"))


def folders(contents: dict, name: str) -> list[str]:
    of = contents["tables"].get(name, {"parts": []})["parts"]
    return list(of) if isinstance(of, list) else [p for bucket in sorted(of, key=int) for p in of[bucket]]


def every_folder(contents: dict) -> list[str]:
    out = [p for name in contents["tables"] for p in folders(contents, name)]
    for index in contents["indexes"].values():
        out += [index["centres"], *index["folders"]]
    return out


class Change:
    """Tables and state on the way from one version to the next."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.versions.latest()
        self.contents = store.versions.contents(self.base)
        self.changed = False

    def __enter__(self) -> Change:
        self.before = dict(self.state)
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None and (self.changed or self.state != self.before):
            self.version = self.store.versions.commit(self.base, self.contents)

    @property
    def state(self) -> dict:
        return self.contents["state"]

    def read(self, name: str) -> DataFrame:
        """The table as this change has it so far."""
        return self.store.rows(name, folders(self.contents, name))

    def write(self, df: DataFrame, name: str, by: str | None = None) -> str:
        """A new data folder, which no version names yet."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.store.root}/{folder}")
        self.changed = True
        return folder

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.hash("file_path"), F.lit(buckets)))

    def _deal(self, name: str, df: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Rows written by bucket: the folder of each."""
        folder = self.write(self._bucketed(df, buckets), name, "bucket")
        inner = [x for x, _ in self.store.versions.names(folder) if x.startswith("bucket=")]
        return {x.removeprefix("bucket="): [f"{folder}/{x}"] for x in inner}

    def create(self, name: str, df: DataFrame) -> None:
        df = df.select(*TABLES[name].fieldNames())
        if name in BUCKETED:
            self.contents["tables"][name] = {"buckets": self.store.buckets, "parts": self._deal(name, df, self.store.buckets)}
        else:
            self.contents["tables"][name] = {"parts": [self.write(df, name)]}

    def append(self, name: str, df: DataFrame) -> None:
        if name not in self.contents["tables"]:
            return self.create(name, df)
        table = self.contents["tables"][name]
        df = df.select(*TABLES[name].fieldNames())
        if name in BUCKETED:
            for bucket, parts in self._deal(name, df, table["buckets"]).items():
                table["parts"][bucket] = table["parts"].get(bucket, []) + parts
        else:
            table["parts"].append(self.write(df, name))

    def replace_files(self, paths: DataFrame, chunks: DataFrame | None = None, name: str = "code_files") -> None:
        """Deletes the rows of the files in ``paths`` (file_path) and adds the given ones, in the touched buckets only."""
        table = self.contents["tables"].setdefault(name, {"buckets": self.store.buckets, "parts": {}})
        n = table["buckets"]
        while n * self.store.bucket_bytes < sum(map(self.store.versions.size, folders(self.contents, name))):
            n *= 2
        if n > table["buckets"]:  # so seldom that what is rewritten in all stays in proportion to the table
            touched = {*table["parts"], *map(str, range(n))}
        else:
            touched = {str(r[0]) for r in paths.select(F.pmod(F.hash("file_path"), F.lit(n))).distinct().collect()}  # ``buckets`` numbers at most
        if not touched:
            return
        old = self.store.rows(name, [p for bucket in table["parts"] if bucket in touched for p in table["parts"][bucket]])
        new = old.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*TABLES[name].fieldNames())
        if chunks is not None:
            new = new.unionByName(chunks.select(*TABLES[name].fieldNames()))
        parts = {b: p for b, p in table["parts"].items() if b not in touched}
        self.contents["tables"][name] = {"buckets": n, "parts": parts | self._deal(name, new, n)}

    def upsert_pulls(self, new: DataFrame) -> None:
        self.create("pr_data", latest_pulls(self.read("pr_data"), new))


def latest_pulls(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("pr_number").distinct(), "pr_number", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def status(commits: DataFrame, chunks: DataFrame, pulls: DataFrame) -> DataFrame:
    """One row: rows and distinct commits, chunks and distinct files, summaries, pull requests."""
    a = commits.agg(F.count("*").alias("commit_rows"), F.countDistinct("hash").alias("commits"))
    b = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.count_if("is_summary").alias("summaries"))
    c = pulls.agg(F.count("*").alias("pulls"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def changes(now: DataFrame, before: DataFrame, key: str = "file_path", digest: str = "content_hash") -> DataFrame:
    """key, change: "new", "changed" or "deleted" between two snapshots of (key, digest)."""
    a, b = now.select(key, F.col(digest).alias("now")), before.select(key, F.col(digest).alias("before"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def unique_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct().orderBy("file_path")


def chunks_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_semi").orderBy("file_path", "start_line")


def by_hash(commits: DataFrame, prefix: str) -> DataFrame:
    """Commits whose hash starts so, with score 0."""
    return commits.where(F.col("hash").startswith(prefix)).withColumn("score", F.lit(0.0))


def recent(commits: DataFrame, n: int) -> DataFrame:
    """The n latest commits, one row each, its first file."""
    once = commits.groupBy("hash").agg(F.min_by(F.struct(*(c for c in commits.columns if c != "hash")), "file_path").alias("r")).select("hash", "r.*")
    return once.orderBy(F.desc("date"), "hash").limit(n)


def edges_from(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("caller_file") == file)


def edges_to(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("callee_file") == file)


def co_changed_with(edges: DataFrame, file: str) -> DataFrame:
    return edges.where((F.col("edge_type") == "co-change") & ((F.col("caller_file") == file) | (F.col("callee_file") == file)))


