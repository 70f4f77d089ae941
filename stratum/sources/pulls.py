"""Pull requests: pages of a service's rows as a data source, and rows as stored ones."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratum.functions import text

RAW = "number int, title string, body string, state string, merged_at timestamp, merged_by string, user string, created_at timestamp, merge_commit_sha string, updated_at timestamp"
DESCRIPTION, ISSUES = 2000, 5


class PullPages(DataSource):
    """Pages as JSON files of a folder, page-<n>.json, a partition for each; what a fetcher of pages leaves behind."""

    @classmethod
    def name(cls) -> str:
        return "pull_pages"

    def schema(self) -> str:
        return RAW.replace("timestamp", "string")

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("page-*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [x.split()[0] for x in RAW.split(", ")]
        for row in json.loads(Path(partition.value).read_text()):
            login = lambda v: v.get("login") if isinstance(v, dict) else v
            yield tuple(login(row.get(n)) for n in names)


def read_pages(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Raw pull requests updated at ``since`` or later."""
    spark.dataSource.register(PullPages)
    raw = spark.read.format("pull_pages").option("path", path).load()
    for c in ("merged_at", "created_at", "updated_at"):
        raw = raw.withColumn(c, F.to_timestamp(c))
    return raw if since is None else raw.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))


def normalised(raw: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Stored pull requests. With ``titles`` (issue, title) the first five linked issues are named, else all are
    numbers only."""
    base = raw.withColumn("issues", text.linked_issues(F.coalesce("body", F.lit(""))))
    if titles is None:
        linked = F.transform("issues", lambda i: F.concat(F.lit("#"), i.cast("string")))
        base = base.withColumn("linked_issues", linked)
    else:
        one = base.select("number", F.posexplode(F.slice("issues", 1, ISSUES)).alias("i", "issue")).join(titles.withColumnRenamed("title", "named"), "issue", "left")
        label = F.coalesce(F.concat("named", F.lit(" (#"), F.col("issue").cast("string"), F.lit(")")), F.concat(F.lit("#"), F.col("issue").cast("string")))
        gathered = one.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", label.alias("label")))), lambda x: x.label).alias("linked_issues"))
        base = base.join(gathered, "number", "left").withColumn("linked_issues", F.coalesce("linked_issues", F.array().cast("array<string>")))
    state = F.when(F.col("merged_at").isNotNull(), "merged").when(F.col("state") == "closed", "closed").otherwise("open")
    return base.select(
        F.col("number").alias("pr_number"), "title", F.substring(F.coalesce("body", F.lit("")), 1, DESCRIPTION).alias("description"), state.alias("state"), F.coalesce("user", F.lit("unknown")).alias("author"),
        F.coalesce("merged_by", F.lit("")).alias("merged_by"), "created_at", "merged_at", "linked_issues", F.coalesce("merge_commit_sha", F.lit("")).alias("resolved_by"),
    )


def embedding_text(pulls: DataFrame) -> Column:
    return text.pull_text(*(F.col(c) for c in ("pr_number", "title", "state", "author", "merged_by", "description")), F.array_join("linked_issues", ", "), F.col("resolved_by"))


class Fetcher:
    """Pages of a service's pull requests, written as files that ``read_pages`` reads.

    ``get`` maps a path with its query to decoded JSON. Pages are by falling time of change. One that holds nothing changed at
    ``since`` or later is the last. With ``at_once`` over 1, as many pages are on their way at a time, and those
    beyond the last are dropped. So are titles of issues, one request each.
    """

    def __init__(self, get: Callable[[str], object], owner: str, name: str, size: int = 100, at_once: int = 3) -> None:
        self.get, self.base, self.size, self.at_once = get, f"/repos/{owner}/{name}", size, at_once

    def page(self, n: int) -> list[dict]:
        return self.get(f"{self.base}/pulls?state=all&sort=updated&direction=desc&per_page={self.size}&page={n}") or []

    def fetch(self, folder: str, since: str = "", on_page: Callable[[int, int], None] | None = None) -> int:
        """The number of pull requests written; each page is there as a whole or not at all."""
        at, total, n = Path(folder), 0, 1
        at.mkdir(parents=True, exist_ok=True)
        with ThreadPoolExecutor(self.at_once) as pool:
            while True:
                for rows in pool.map(self.page, range(n, n + self.at_once)):
                    new = [r for r in rows if str(r.get("updated_at") or "") >= since]
                    if new:
                        part = at / f".page-{n}.json"
                        part.write_text(json.dumps(new))
                        part.rename(at / f"page-{n}.json")
                    total += len(new)
                    if on_page:
                        on_page(n, total)
                    if len(rows) < self.size or len(new) < len(rows):
                        return total
                    n += 1

    def titles(self, issues: list[int]) -> dict[int, str]:
        """Titles of those issues that can be had."""

        def one(i: int) -> tuple[int, str | None]:
            try:
                return i, (self.get(f"{self.base}/issues/{i}") or {}).get("title")
            except (OSError, ValueError):
                return i, None

        with ThreadPoolExecutor(self.at_once) as pool:
            return {i: t for i, t in pool.map(one, dict.fromkeys(issues)) if t}
