"""Embeddings by a model of one's own, or by hashed words where there is none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
BATCH = 32


class HashedWords:
    """Counts of hashed words with signs, of unit length; a stand-in for a sentence model."""

    def __init__(self, size: int = 384) -> None:
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embedded(table: DataFrame, text: str = "text", vector: str = "vector", make: Callable[[], Embedder] = HashedWords) -> DataFrame:
    """Adds ``vector``. ``make`` builds the model once for each Python worker; texts come in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            values = texts.fillna("").tolist()
            rows = [r for i in range(0, len(values), BATCH) for r in model(values[i : i + BATCH])]
            yield pd.Series([r.tolist() for r in rows])

    return table.withColumn(vector, run(F.col(text)))


def embed_one(text: str, model: Embedder | None = None) -> list[float]:
    return (model or HashedWords())([text])[0].tolist()


class SentenceModel:
    """A sentence model exported to ONNX, from a folder with model.onnx and tokenizer.json: the mean of the last layer over
    a text's tokens, of length one. ``session`` and ``tokenizer`` may be given instead. Made once for each Python worker."""

    def __init__(self, folder: str = "", session: object = None, tokenizer: object = None, most: int = 256) -> None:
        if session is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(f"{folder}/model.onnx")
        if tokenizer is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.session, self.tokenizer, self.most = session, tokenizer, most

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows = [self.tokenizer.encode(t).ids[: self.most] or [0] for t in texts]
        ids = np.zeros((len(rows), max(map(len, rows), default=1)), np.int64)
        mask = np.zeros_like(ids)
        for i, r in enumerate(rows):
            ids[i, : len(r)], mask[i, : len(r)] = r, 1
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        feed = {x.name: known[x.name] for x in self.session.get_inputs() if x.name in known}
        layer = np.asarray(self.session.run(None, feed)[0])
        mean = (layer * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
