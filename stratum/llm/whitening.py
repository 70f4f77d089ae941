"""Whitening of embeddings by a covariance that is computed in tiles of dimension pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut, small_batches
from stratum.llm.vectors import long_or_none, matrix, vectors

#: Beyond this a scaled component is no long.
LARGEST = float(1 << 60)


@dataclass(frozen=True)
class Params:
    """scale, shift: of entries before they become whole numbers. components: at most, of those returned. tile: dimensions
    of a column block. rows: of a row block. least: share of the largest eigenvalue below which a direction counts as one without
    variance, which can't be scaled to one."""

    scale: int = 64
    shift: int = 1_000_000
    components: int = 16
    tile: int = 16
    rows: int = 2000
    least: float = 1e-9


@dataclass(frozen=True)
class Basis:
    """What the fit list gives: its size, sums by dimension, eigenvalues, eigenvectors as columns, shares of the whole variance,
    and how far the covariance of whitened rows is from the identity. As large as a square of the dimensions."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def scaled(table: DataFrame, p: Params) -> DataFrame:
    """vec_id and x of the rows that take part."""
    rows = vectors(table).where(~F.exists("vector", lambda c: F.abs(c) * p.scale >= LARGEST))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * p.scale).cast("long") + F.lit(p.shift).cast("long")).alias("x"))


def usual_width(rows: DataFrame) -> int:
    """The number of dimensions that most rows have, the larger of several; 0 without rows."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows, and exact sums by dimension, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = matrix(b.column(0))
            n, high, low = n + len(x), high + (x >> 31).sum(0), low + (x & 0x7FFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["dimension", "n", "high", "low"])

    rows = fit.mapInArrow(run, "dimension int, n long, high long, low long").groupBy("dimension").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()  # a row a dimension
    sums = np.zeros(d, object)
    for r in rows:
        sums[r.dimension] = (r.high << 31) + r.low
    return max((r.n for r in rows), default=0), sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean. The nearest whole number is taken off first, exactly, so what a double rounds is small."""
    floor = sums // n
    return (x - floor.astype(np.int64)).astype(float) - ((sums - floor * n).astype(float) / n)


def tiled(fit: DataFrame, d: int, n: int, sums: np.ndarray, p: Params) -> np.ndarray:
    """The covariance, with divisor n.

    A task cuts each batch, a row block, into column blocks of ``tile`` dimensions. Blocks are shuffled by row block, so those of the
    same rows meet; each pair of them makes a part of the tile that it is the key of; and the parts are summed by tile. What is
    shuffled are whole numbers, centred on arrival before they are multiplied. No row block is larger than another, whatever
    values repeat, and tiles are as many as pairs of column blocks.
    """
    whole = sums // n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 32
        for b in batches:
            x = matrix(b.column(0))
            for start in range(0, len(x), p.rows):
                near = x[start : start + p.rows] - whole.astype(np.int64)
                kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if k is np.int64 or np.abs(near).max() <= np.iinfo(k).max)
                blocks = range(0, d, p.tile)
                packed = [np.ascontiguousarray(near[:, c : c + p.tile], kind).tobytes() for c in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([len(near)] * len(blocks), pa.int32()), pa.array([np.dtype(kind).str] * len(blocks)), pa.array(packed, pa.binary())], ["row_block", "column_block", "n", "kind", "cells"])
                at += 1

    def multiply(block: pa.Table) -> pa.Table:
        rest = (sums - whole * n).astype(float) / n
        parts: dict[int, np.ndarray] = {}
        for r in block.to_pylist():
            c = r["column_block"]
            x = np.frombuffer(r["cells"], r["kind"]).reshape(r["n"], -1).astype(float)
            parts[c] = x - rest[c * p.tile : c * p.tile + x.shape[1]]
        tiles = [(i, j, (parts[i].T @ parts[j]).ravel()) for i in parts for j in parts if i <= j]
        return pa.table({"i": pa.array([t[0] for t in tiles], pa.int32()), "j": pa.array([t[1] for t in tiles], pa.int32()), "cells": pa.array([t[2].tolist() for t in tiles], pa.list_(pa.float64()))})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                key = r["i"], r["j"]
                sums[key] = sums.get(key, 0.0) + np.array(r["cells"])
        for (i, j), cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(cells), pa.int32()), pa.array([j] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["i", "j", "cell", "value"])

    blocks = fit.mapInArrow(cut, "row_block long, column_block int, n int, kind string, cells binary")
    tiles = blocks.groupBy("row_block").applyInArrow(multiply, "i int, j int, cells array<double>")
    v = np.zeros((d, d))
    for r in tiles.mapInArrow(add_up, "i int, j int, cell int, value double").groupBy("i", "j", "cell").agg(F.sum("value").alias("value")).collect():  # a row a pair of dimensions
        a, b = divmod(r.cell, min(p.tile, d - r.j * p.tile))
        v[r.i * p.tile + a, r.j * p.tile + b] = v[r.j * p.tile + b, r.i * p.tile + a] = r.value
    return v / n


def whitened(x: np.ndarray, basis: Basis) -> np.ndarray:
    return centred(x, basis.n, basis.sums) @ basis.directions / np.sqrt(basis.values)


def identity_error(fit: DataFrame, basis: Basis) -> float:
    """The largest entry of the covariance of whitened rows, less the identity; tasks sum up products of their own rows."""
    k = len(basis.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k + 1, k + 1))
        for b in batches:
            w = whitened(matrix(b.column(0)), basis)
            w = np.hstack([w, np.ones((len(w), 1))])
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(products.ravel())], ["at", "sum"])

    sums = np.zeros((k + 1) ** 2)
    for r in fit.mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():  # a row an entry
        sums[r["at"]] = r["sum"]
    products = sums.reshape(k + 1, k + 1) / basis.n
    mean = products[:k, k]
    return float(np.abs(products[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def fitted(rows: DataFrame, p: Params) -> Basis | None:
    """The basis of the distinct vectors of ``rows``, all of one width; None if no direction varies."""
    d = usual_width(rows)
    with Cut(rows.sparkSession, "whitening") as cut:
        fit = cut.write(rows.where(F.size("x") == d).select("x").distinct(), "fit")
        n, sums = totals(fit, d)
        if not n or not d:
            return None
        v = tiled(fit, d, n, sums, p)
        values, directions = np.linalg.eigh(v)
        by = np.argsort(-values, kind="stable")[: p.components]
        by = by[values[by] > max(values.max() * p.least, 0.0)]
        if not len(by):
            return None
        basis = Basis(n, sums, values[by], directions[:, by], values[by] / np.trace(v))
        return Basis(n, sums, basis.values, basis.directions, basis.explained, identity_error(fit, basis))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sums over dimensions of (n * x - S) ** 2, exactly; None if beyond a long."""
    away = [x[:, k] - int(s // n) for k, s in enumerate(sums)]
    most = max((int(np.abs(a).max()) + 1 for a in away), default=0) * n
    if most**2 * max(1, len(sums)) < 1 << 62:
        return sum(((n * a - int(s % n)) ** 2 for a, s in zip(away, sums)), np.zeros(len(x), np.int64)).tolist()
    return [long_or_none(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))) for row in x]


def whiten(table: DataFrame, params: Params | None = None) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error: a row for each
    vector that takes part and each of the first ``components`` directions.

    The mean and the covariance are those of the distinct vectors, which one exchange with partial distinct sets leaves over, so a
    vector that a third of all rows hold is one row from then on. The covariance is summed in tiles; it, and the sums, are all
    that the driver sees. The rows are whitened in one narrow pass over the table.

    Vectors that are null or hold null, nan or infinity take no part; neither do those of another length than most have (the longer
    of two that are as frequent) or with an entry beyond a long once scaled. A deviation beyond a long is null. Directions
    without variance, of less than ``least`` of the largest, can't be whitened and have no rows, so where all vectors are equal
    there are none. Repeated rows give rows each; a null vec_id stays; an empty table gives no rows; further columns are ignored.
    """
    p = params or Params()
    small_batches(table.sparkSession, p.rows)
    rows = scaled(table, p)
    basis = fitted(rows, p)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if basis is None:
        return rows.where("false").mapInArrow(lambda batches: iter(()), schema)
    k = len(basis.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            ids = np.repeat(np.arange(len(x)), k)
            many = lambda values: pa.array(np.tile(values, len(x)))
            away = pa.array(deviations(x, basis.n, basis.sums), pa.int64()).take(pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids)), many(np.arange(1, k + 1, dtype=np.int32)), many(np.array([basis.n] * k)), away, pa.array(whitened(x, basis).ravel()), many(basis.explained), many(np.array([basis.error] * k))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == len(basis.sums)).mapInArrow(run, schema)
