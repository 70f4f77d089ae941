"""Packing of documents into sequences of balanced attention cost, without padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.llm import vocab
from stratum.llm.common import small_batches, texts


@dataclass(frozen=True)
class Params:
    """length: tokens of a sequence. end: the id after each document. block: tokens that are packed together.
    linear, quadratic: cost of a piece of n tokens is linear * n + quadratic * n * n, as attention stays within
    a document; by default a token's own work is that of attention to 512 tokens."""

    bpe: str = field(default_factory=lambda: vocab.default_path("byte_bpe_50k.json"))
    length: int = 2048
    end: int = 1
    block: int = 4_000_000
    linear: float = 512.0
    quadratic: float = 1.0


def capacities(tokens: int, length: int) -> list[int]:
    """Full sequences, then what is left as powers of two, which need no padding."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def assign(sizes: list[int], p: Params) -> list[list[tuple[int, int, int, int]]]:
    """(start, length, sequence, offset) of the pieces of each of some documents.

    What a document has beyond whole sequences is its remainder. Whole sequences of long documents stand alone.
    Remainders go by descending cost, each to the sequence of lowest cost that has room for it; where none has,
    it is cut and fills the one of most room first. The capacities sum up to the tokens, so all get full.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    sequence = 0
    for i, n in enumerate(sizes):
        for start in range(0, n - n % p.length, p.length):
            out[i].append((start, p.length, sequence, 0))
            sequence += 1
    left = sorted(((n % p.length, i) for i, n in enumerate(sizes) if n % p.length), key=lambda x: (-x[0], x[1]))
    room = np.array(capacities(sum(n for n, _ in left), p.length), np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    for n, i in left:
        start = sizes[i] - n
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(room.argmax())
            take = min(n, int(room[at]))
            out[i].append((start, take, sequence + at, int(size[at] - room[at])))
            room[at] -= take
            cost[at] += p.linear * take + p.quadratic * take * take
            start, n = start + take, n - take
    return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
SCHEMA = ", ".join(f"{x} long" for x in NAMES)


def packed(p: Params, with_ids: bool):
    def block(first: int, docs: list[tuple[int | None, np.ndarray]]) -> tuple[list[tuple], int]:
        rows: list[tuple] = []
        lengths: dict[int, int] = {}
        for (doc_id, ids), pieces in zip(docs, assign([len(x) for _, x in docs], p)):
            for start, n, at, offset in pieces:
                part = ids[start : start + n].astype("<u4")
                lengths[at] = lengths.get(at, 0) + n
                rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), first + at, offset, at, part))
        ready = [(*r[:7], lengths[r[7]], *([r[8]] if with_ids else [])) for r in rows]
        return ready, first + len(lengths)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[8:]]
        return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = vocab.byte_bpe(p.bpe)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.batch(b.column(1).to_pylist())):
                docs.append((doc_id, np.append(ids, ids.dtype.type(p.end))))
                held += len(ids) + 1
                if held >= p.block:
                    rows, first = block(first, docs)
                    yield table(rows)
                    docs, held = [], 0
        if docs:
            yield table(block(first, docs)[0])

    return run


def pack(docs: DataFrame, params: Params | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, and with ``with_ids`` the ids themselves.

    Each task packs what it reads in blocks of about ``block`` tokens, so nothing is shuffled, memory is bounded
    by a block and a document, and any number of tasks work alike. sequence_id counts from the task's number
    shifted by 40 bits. Sequences hold ``length`` tokens, except that a block's rest is cut at powers of two.

    Null and empty texts are one end token. Each of repeated rows, with the same doc_id or a null one, is a
    document of its own. Texts of more than a sequence take several. An empty table gives no rows.
    """
    p = params or Params()
    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(packed(p, with_ids), SCHEMA + ", ids array<long>" * with_ids)
