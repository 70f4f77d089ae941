"""A git repository as a data source: commits with their diffs in pages, files, and the log with statistics."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stratum.functions import paths
from stratum.operators import diff

PAGE, LARGE = 200, 5000
#: Characters of files that are handed on at once.
BYTES = 16 << 20
FIELD, RECORD = "\x1f", "\x1e"
FORMAT = f"%H{FIELD}%an{FIELD}%aI{FIELD}%s"


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace", check=True).stdout


class GitLog(DataSource):
    """hash, author, date, message, diff. Options: path, since and until (hashes), limit (0: all), page. A page is a partition,
    so executors read pages in parallel; each needs the repository at the same path."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, author string, date string, message string, diff string"

    def reader(self, schema) -> "LogReader":
        return LogReader(self.options)

    def streamReader(self, schema) -> "LogStream":
        return LogStream(self.options)


def pages(hashes: list[str], page: int) -> list[InputPartition]:
    return [InputPartition(hashes[i : i + page]) for i in range(0, len(hashes), page)]


def commits_of(repo: str, hashes: list[str]) -> Iterator[tuple]:
    """hash, author, date, message and diff of each commit."""
    command = ["git", "-C", repo, "log", "--no-walk=unsorted", "--stdin", "--patch", "--no-color", f"--format={RECORD}{FORMAT}{FIELD}"]
    out = subprocess.run(command, input="\n".join(hashes), capture_output=True, text=True, errors="replace", check=True).stdout
    for record in out.split(RECORD)[1:]:
        hash_, author, date, message, body = record.split(FIELD, 4)
        yield hash_, author, date, message, body.lstrip("\n")


class LogStream(DataSourceStreamReader):
    """The commits that land, in order. An offset is the hash of a head: a batch is what its end has and its start hasn't, so it is the
    same however often it is asked for.
    Options: path, since, page. A page is a partition, so a long history is as many tasks."""

    def __init__(self, options) -> None:
        self.repo, self.since = options["path"], options.get("since", "")
        self.page = int(options.get("page", PAGE))

    def initialOffset(self) -> dict:
        return {"hash": self.since}

    def latestOffset(self) -> dict:
        return {"hash": git(self.repo, "rev-parse", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = start["hash"], end["hash"]
        if since and not known(self.repo, since):
            raise ValueError(f"commit {since} is gone: history was rewritten, so the stream has to begin anew")
        return pages(git(self.repo, "rev-list", "--reverse", f"{since}..{until}" if since else until).split(), self.page)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return commits_of(self.repo, partition.value)

    def commit(self, end: dict) -> None:
        """Nothing is to be let go of: git keeps all commits."""


class LogReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo, self.since, self.until = options["path"], options.get("since", ""), options.get("until", "")
        self.limit, self.page = int(options.get("limit", 0)), int(options.get("page", PAGE))

    def revisions(self) -> list[str]:
        return [f"{self.since}..{self.until or 'HEAD'}"] if self.since else [self.until or "--all"]

    def partitions(self) -> list[InputPartition]:
        """The commits' hashes are listed once, so pages stay as they are while commits land, and git goes to each at once."""
        most = [f"--max-count={self.limit}"] if self.limit else []
        hashes = git(self.repo, "rev-list", *most, *self.revisions()).split()
        return pages(hashes, self.page)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return commits_of(self.repo, partition.value)


def follow_log(spark: SparkSession, repo: str, since: str = "", page: int = PAGE) -> DataFrame:
    """The log as a stream of the commits after ``since``."""
    spark.dataSource.register(GitLog)
    return spark.readStream.format("git_log").option("path", str(Path(repo).resolve())).option("since", since).option("page", page).load().withColumn("date", F.to_timestamp("date"))


def read_log(spark: SparkSession, repo: str, since: str = "", limit: int = 0, page: int = PAGE, until: str = "") -> DataFrame:
    spark.dataSource.register(GitLog)
    log = spark.read.format("git_log").option("path", repo).option("since", since).option("until", until).option("limit", limit).option("page", page).load()
    return log.withColumn("date", F.to_timestamp("date"))


def commit_rows(log: DataFrame) -> DataFrame:
    """A row for each commit and file that isn't left out, with the diff condensed to the file's budget and the
    commit's other files; a commit without such a file has one row with an empty path."""
    parts = diff.by_file(log).where(~paths.excluded(F.col("file_path")))
    per = parts.select("hash", "file_path", diff.condensed(F.col("raw_diff"), paths.diff_budget(F.col("file_path"))).alias("condensed_diff"), "place")
    gathered = per.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("place", "file_path", "condensed_diff"))).alias("files"))
    names = F.coalesce(F.transform("files", lambda x: x.file_path), F.array().cast("array<string>"))
    some = log.drop("diff").join(gathered, "hash", "left").withColumn("names", names)
    one = some.select("hash", "author", "date", "message", "names", F.explode_outer("files").alias("f"))
    path = F.coalesce("f.file_path", F.lit(""))
    return one.select("hash", "author", "date", "message", path.alias("file_path"), F.coalesce("f.condensed_diff", F.lit("")).alias("condensed_diff"), F.filter("names", lambda x: x != path).alias("files_changed"))


def latest_hash(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("hash", F.struct("date", "hash")).alias("hash"))


def known(repo: str, hash_: str) -> bool:
    """Whether the repository still has the commit; not after a rebase."""
    return subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{hash_}^{{commit}}"], capture_output=True).returncode == 0


def scale(count: int) -> str:
    return "large" if count > LARGE else "small"


def count_commits(repo: str, otherwise: int = 1000) -> int:
    try:
        return int(git(repo, "rev-list", "--count", "HEAD"))
    except (subprocess.CalledProcessError, ValueError, OSError):
        return otherwise


def list_files(repo: str) -> list[str]:
    return [x.strip() for x in git(repo, "ls-files", "--cached", "--others", "--exclude-standard").split("\n") if x.strip()]


def read_files(spark: SparkSession, repo: str, names: list[str] | None = None) -> DataFrame:
    """file_path, content of the tracked and new files that aren't left out; files that can't be read are skipped."""
    root = str(Path(repo).resolve())
    listed = spark.createDataFrame([(x,) for x in (list_files(repo) if names is None else names)], "file_path string").where(~paths.excluded(F.col("file_path"), sources=True) & paths.is_safe(F.col("file_path")))

    def read(rows):
        for batch in rows:
            found, size = [], 0
            for p in batch.file_path:
                at = Path(root, p)
                try:
                    if at.resolve().is_relative_to(root):
                        found.append((p, at.read_text(encoding="utf-8", errors="replace")))
                        size += len(found[-1][1])
                except OSError:
                    continue
                if size > BYTES:
                    yield type(batch)(found, columns=["file_path", "content"])
                    found, size = [], 0
            yield batch.iloc[:0].assign(content=None) if not found else type(batch)(found, columns=["file_path", "content"])

    return listed.mapInPandas(read, "file_path string, content string")


def summary_log(spark: SparkSession, repo: str, since: str, limit: int = 200) -> DataFrame:
    """Commits without merges since a date: hash, author, date, message, insertions, deletions, lines_changed."""
    out = git(repo, "log", "--no-merges", f"--since={since}", f"--max-count={limit}", "--shortstat", f"--format={RECORD}{FORMAT}{FIELD}")
    rows = [tuple(x.split(FIELD, 4)) for x in out.split(RECORD)[1:]]
    return diff.contents(spark.createDataFrame(rows, "hash string, author string, date string, message string, stat string")).drop("stat").withColumn("date", F.to_timestamp("date"))


def full_diff(repo: str, hash_: str) -> str:
    return git(repo, "show", "--stat", "--patch", "--no-color", "--format=", hash_)


def blame_line(repo: str, file: str, line: int) -> dict[str, str] | None:
    """hash, author and summary of the commit that a line is from."""
    try:
        lines = git(repo, "blame", "-L", f"{line},{line}", "--porcelain", "--", file).split("\n")
    except subprocess.CalledProcessError:
        return None
    tags = dict(x.split(" ", 1) for x in lines[1:] if " " in x and not x.startswith("\t"))
    return {"hash": lines[0].split(" ")[0], "author": tags.get("author", ""), "summary": tags.get("summary", "")}


def repository(remote: Column) -> tuple[Column, Column]:
    """Owner and name of a remote's address or of "owner/name"; null if it is neither."""
    pattern = r"(?:^|[:/])([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
    part = lambda i: F.when(remote.rlike(pattern), F.regexp_extract(remote, pattern, i))
    return part(1), part(2)
