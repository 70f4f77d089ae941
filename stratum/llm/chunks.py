"""Chunks of documents, compiled once: words become ordinals of a chunk's distinct words, in a written table.

Operators over n-grams ask hash buckets about the distinct n-grams of a chunk, and a bucket answers each chunk about
its own. So an n-gram is one entry of a chunk however often the chunk has it, and nothing but the chunk itself holds
all of its occurrences. A cell, what one chunk sends to one bucket, is a row; empty cells aren't sent, so there are
never more rows than distinct n-grams, and a number of buckets that grows with the corpus costs no more than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bits of a hash within its bucket. Buckets are of bounded size, so whatever the size of the corpus, an n-gram is
#: taken for another with a chance of about the entries of a bucket in 2**BITS. Bits of a word's hash.
BITS = 40
WORD_BITS = 48
#: Documents of one chunk at most, and chunks of one task.
DOCS = 1 << 18


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers or bytes as compressed planes of their bytes."""
    head, body = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        head += [x.dtype.str.encode().ljust(4), len(x).to_bytes(5, "little")]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(arrays)]) + b"".join(head) + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1 + 9 * raw[0], []
    for i in range(raw[0]):
        kind = np.dtype(raw[1 + 9 * i : 5 + 9 * i].decode().strip())
        n = int.from_bytes(raw[5 + 9 * i : 10 + 9 * i], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def ascending(keys: np.ndarray) -> np.ndarray:
    """The differences of ascending numbers; ``np.cumsum`` undoes it."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Documents in order of doc_id, null ids last. ids, null, flag, lengths: of each document; flat: the ordinal of
    each word of all documents, one after the other; hashes: 64 bits of each distinct word, by ordinal."""

    ids: np.ndarray
    null: np.ndarray
    flag: np.ndarray
    lengths: np.ndarray
    flat: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, bool]]) -> Chunk:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        ordinal: dict[bytes, int] = {}
        parts = []
        for _, text, _ in rows:
            words = text.encode().lower().split()
            for w in words:
                if w not in ordinal:
                    ordinal[w] = len(ordinal)
            parts.append(np.fromiter(map(ordinal.__getitem__, words), np.uint32, len(words)))
        ids = np.array([0 if i is None else i for i, _, _ in rows], np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ordinal), np.uint64, len(ordinal)) & np.uint64((1 << WORD_BITS) - 1)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return cls(ids, np.array([i is None for i, _, _ in rows], bool), np.array([f for _, _, f in rows], bool), np.array([len(x) for x in parts], np.int64), flat, hashes)

    @classmethod
    def load(cls, blob: bytes) -> Chunk:
        ids, null, flag, lengths, flat, hashes = unpack(blob)
        return cls(np.cumsum(ids), null.astype(bool), flag.astype(bool), lengths.astype(np.int64), flat, hashes)

    def dump(self) -> bytes:
        return pack(ascending(self.ids), self.null.view(np.uint8), self.flag.view(np.uint8), self.lengths.astype(np.uint32), self.flat, self.hashes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def compiled(docs: DataFrame, chars: int) -> DataFrame:
    """chunk, n_docs, n_words, blob, of documents (doc_id long, text string, flag boolean): as many documents of a partition as
    have ``chars`` characters or more together. To be written at once, as a chunk is known by the place of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, number = 0, TaskContext.get().partitionId() << 20

        def flush() -> pa.RecordBatch:
            c = Chunk.of(held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(c.ids)], pa.int64()), pa.array([len(c.flat)], pa.int64()), pa.array([c.dump()], pa.binary())], ["chunk", "n_docs", "n_words", "blob"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                held.append(row)
                size += len(row[1]) + 8
                if size >= chars or len(held) >= DOCS:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return docs.select("doc_id", "text", "flag").mapInArrow(run, "chunk long, n_docs long, n_words long, blob binary")


def bucket_bits(entries: int, most: int) -> int:
    """Bits that name a bucket, so that one has about ``most`` entries at most."""
    return max(0, (-(-max(1, entries) // most) - 1).bit_length())


def cells(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the cells of ascending 64-bit hashes that aren't empty."""
    if not len(keys):
        return []
    own = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    first = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
    return [(int(own[a]), int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(keys)))]


def inner(keys: np.ndarray, bits: int) -> np.ndarray:
    """Hashes within a bucket, without its bits, still ascending."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - BITS)
