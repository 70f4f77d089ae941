"""Inverted lists of byte codes over the vectors of a store's tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import search
from stratum.sources.store import Store, folders


@dataclass(frozen=True)
class Params:
    """lists: of an index; by default the root of the rows. sample: vectors at most that the centres are trained on. assign: lists
    that each row goes into. probes: share of the lists that a search reads. refine: candidates by codes for each row wanted,
    whose whole vectors are read. grown: factor by which a table grows before the centres are trained anew."""

    lists: int | None = None
    sample: int = 20_000
    assign: int = 2
    probes: float = 0.4
    refine: int = 5
    grown: float = 4.0


ROWS = "list_id int, part string, file string, row long, codes array<tinyint>"


def place() -> tuple[Column, Column]:
    """The file of a row, below the data folder, and the folder it lies in, which is a part of the table."""
    file = F.substring_index(F.col("_metadata.file_path"), "/data/", -1)
    return file, F.regexp_replace(file, "/[^/]*$", "")


class CodeIndex:
    """An index of one table. A row is in the lists of its ``assign`` nearest centres, as a code of a byte a dimension and the file and place
    where its whole vector lies. Files never change, so an entry holds as long as its file's folder is part of the table.

    A version of the store names the folders that are indexed. Rows of parts that aren't yet, as they were added since, are
    searched whole, and entries of parts that are gone are passed over; so a search sees the table as it is, whenever
    ``update`` last ran, and that only goes through the new parts.
    """

    def __init__(self, store: Store, name: str, params: Params | None = None) -> None:
        self.store, self.spark, self.name, self.p = store, store.spark, name, params or Params()

    def about(self) -> dict:
        return self.store.contents()["indexes"].get(self.name, {})

    def update(self) -> bool:
        """Indexes the parts that aren't; trains centres where there are none yet, none of their parts is left, or the table has grown
    so much that lists would be too long. Whether there was anything to do."""
        with self.store.change() as change:
            about = change.contents["indexes"].get(self.name)
            current = [p.removeprefix("data/") for p in folders(change.contents, self.name)]
            rows = change.read(self.name)
            total = rows.where(F.size("vector") > 0).count()
            if not total:
                return change.contents["indexes"].pop(self.name, None) is not None
            live = [p for p in (about or {"parts": []})["parts"] if p in set(current)]
            if not live or total > self.p.grown * about["rows"]:
                lists = self.p.lists or max(1, math.isqrt(total))
                centres = search.train_centres(rows, lists, self.p.sample)
                # codes hold nearly all components; the few beyond are cut off, and put right by whole vectors
                scale = 127.0 / max(1e-12, float(np.quantile(np.abs(centres), 0.999)) * 2)
                table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centre array<double>")
                about, live = {"centres": change.write(table.coalesce(1), f"{self.name}-centres"), "folders": [], "rows": total, "scale": scale}, []
            else:
                centres = self.centres(about)
            new = [p for p in current if p not in set(live)]
            if new:
                table = self.store.rows(self.name, [f"data/{p}" for p in new])
                about["folders"].append(change.write(self.entries(table, centres, about["scale"]).repartition("list_id"), f"{self.name}-lists", "list_id"))
            about["parts"] = current
            change.contents["indexes"][self.name] = about
            return bool(new)

    def centres(self, about: dict) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.store.root}/{about['centres']}").collect()  # a row a list
        return np.array([r.centre for r in sorted(rows, key=lambda r: r.list_id)], float)

    def entries(self, table: DataFrame, centres: np.ndarray, scale: float) -> DataFrame:
        width, most = centres.shape[1], min(self.p.assign, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(b), width).astype(float)
                far = (centres * centres).sum(1) - 2 * x @ centres.T
                near = np.argsort(far, 1, kind="stable")[:, :most]
                codes = np.clip(np.rint(x * scale), -127, 127).astype(np.int8)
                again = np.repeat(np.arange(len(b)), most)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(again) + 1) * width, width), pa.int32()), pa.array(codes[again].ravel(), pa.int8()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(b.column(i).take(pa.array(again)) for i in range(3)), flat], ["list_id", "part", "file", "row", "codes"])

        file, part = place()
        rows = table.where(F.size("vector") == width).select(part.alias("part"), file.alias("file"), F.col("_metadata.row_index").alias("row"), "vector")
        return rows.mapInArrow(run, ROWS)

    def pointed(self, at: DataFrame, files: list[str]) -> DataFrame:
        """The rows at these places, of which there are a few; only their files are read."""
        rows = self.store.rows(self.name, [f"data/{f}" for f in files])
        file, _ = place()
        with_place = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return with_place.join(F.broadcast(at), ["_file", "_row"])

    def search(self, query: Sequence[float], k: int, key: Sequence[str], probes: int | None = None) -> DataFrame:
        """The k nearest rows, with score: candidates by codes from the nearest lists, ordered by their whole vectors, and beside them
        the nearest of what isn't indexed yet."""
        current = [p.removeprefix("data/") for p in self.store.parts(self.name)]
        about = self.about()
        indexed = set(about.get("parts", [])) & set(current)
        rest = search.knn(self.store.rows(self.name, [f"data/{p}" for p in current if p not in indexed]), query, k, key)
        if not indexed:
            return rest
        centres = self.centres(about)
        if centres.shape[1] != len(query):
            return rest
        probes = probes or max(1, math.ceil(len(centres) * self.p.probes))
        order = ((centres - np.array(query, float)) ** 2).sum(1).argsort(kind="stable")[:probes].tolist()
        entries = None
        for folder in about["folders"]:
            e = self.spark.read.schema(ROWS).parquet(f"{self.store.root}/{folder}")
            entries = e if entries is None else entries.unionByName(e)
        q = [float(x) * about["scale"] for x in query]
        here = entries.where(F.col("list_id").isin(order) & F.col("part").isin(sorted(indexed)))
        # a row may be in several of the lists
        rough = here.select("file", "row", search.distance(F.col("codes"), q).alias("rough")).orderBy("rough", "file", "row").limit(self.p.assign * self.p.refine * k).collect()
        places = list(dict.fromkeys((r.file, r.row) for r in rough))[: self.p.refine * k]
        if not places:
            return rest
        at = self.spark.createDataFrame(places, "_file string, _row long")
        near = self.pointed(at, sorted({f for f, _ in places})).withColumn("score", search.distance(F.col("vector"), query)).select(*key, "_file", "_row", "score")
        best = near.orderBy("score", *key).limit(k).select("_file", "_row", "score").collect()
        found = self.pointed(self.spark.createDataFrame(best, "_file string, _row long, score double"), sorted({r["_file"] for r in best})).drop("_file", "_row", "vector")
        return found.unionByName(rest).orderBy("score", *key).limit(k)
