"""Quality classifier by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Cut, fold, pick, small_batches, texts, told_apart

#: Classes of bytes, in the order of the shares that a passage's encoding starts with.
CLASSES = [
    ("lower", set(range(97, 123))), ("upper", set(range(65, 91))), ("digit", set(range(48, 58))), ("space", set(b" \t\r\x0b\x0c")), ("line", set(b"\n")),
    ("stop", set(b".?")), ("comma", set(b",;:'\"()")), ("shout", set(b"!")), ("symbol", set(b"#*$%&<>")), ("bar", set(b"|")), ("other", set(b"@/\\_=+-~^`[]{}")), ("beyond", set(range(128, 256))),
]
OF_BYTE = np.full(256, len(CLASSES), np.uint8)
for _i, (_, _bytes) in enumerate(CLASSES):
    OF_BYTE[list(_bytes)] = _i
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Buckets of the hashed words.
HASHED = 64
WIDTH = len(CLASSES) + 7 + HASHED


@dataclass(frozen=True)
class Params:
    """sample: labelled documents to fit on at most, the first by hash; passages: whole documents are taken in that order
    until they have so many together. Both bound what comes to the driver, none cuts a document. passage: words of a
    passage. hidden, attention: sizes of the layers. threshold: least score of label 1."""

    sample: int = 4000
    passages: int = 400_000
    passage: int = 64
    hidden: int = 24
    attention: int = 12
    epochs: int = 60
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 5


def encode(text: str, passage: int) -> np.ndarray:
    """A row of features for each passage of so many words; an empty text is one passage of zeros."""
    raw = text.encode()
    spans = [m.start() for m in WORD.finditer(raw)]
    if not spans:
        return np.zeros((1, WIDTH), np.float32)
    n = len(spans)
    starts = np.array(spans[::passage])
    starts[0] = 0
    sizes = np.diff(starts, append=len(raw)).astype(np.float64)
    out = np.zeros((len(starts), WIDTH), np.float32)
    place = np.repeat(np.arange(len(starts)), sizes.astype(np.int64))
    kinds = OF_BYTE[np.frombuffer(raw, np.uint8)]
    shares = np.bincount(place * (len(CLASSES) + 1) + kinds, minlength=len(starts) * (len(CLASSES) + 1)).reshape(len(starts), -1)
    out[:, : len(CLASSES)] = shares[:, :-1] / sizes[:, None]
    words = raw.lower().split()
    at = len(CLASSES)
    for i in range(len(starts)):
        own = words[i * passage : (i + 1) * passage]
        k = len(own)
        pairs = len(set(zip(own, own[1:])))
        lengths = sum(map(len, own))
        out[i, at : at + 7] = (len(set(own)) / k, pairs / max(1, k - 1), lengths / k / 10.0, sum(len(w) > 14 for w in own) / k, sum(len(w) < 4 for w in own) / k, k / passage, sum(a == b for a, b in zip(own, own[1:])) / k)
        for w in own:
            out[i, at + 7 + (sum(w[:3]) * 7 + len(w) + w[-1]) % HASHED] += 4.0 / k
    return out if n else out


class Model:
    """Passages go through a tanh layer; gated attention weighs them; a logistic unit scores their mean."""

    NAMES = ("w", "b", "v", "u", "a", "o", "c")

    def __init__(self, p: Params, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(p.seed)
        self.mean, self.scale = mean.astype(np.float64), scale.astype(np.float64)
        init = lambda m, n: rng.normal(0, 1 / np.sqrt(m), (m, n))
        self.w, self.b = init(WIDTH, p.hidden), np.zeros(p.hidden)
        self.v, self.u, self.a = init(p.hidden, p.attention), init(p.hidden, p.attention), init(p.attention, 1)[:, 0]
        self.o, self.c = init(p.hidden, 1)[:, 0], np.zeros(1)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags; ``bags`` has the first passage of each."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        logit = (t * g) @ self.a
        of = np.repeat(np.arange(len(bags)), np.diff(bags, append=len(x)))
        e = np.exp(logit - np.maximum.reduceat(logit, bags)[of])
        weight = e / np.add.reduceat(e, bags)[of]
        z = np.add.reduceat(h * weight[:, None], bags, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ self.o + self.c, -30, 30)))
        return y, (x, h, t, g, of, weight, z)

    def gradient(self, y: np.ndarray, label: np.ndarray, kept: tuple, bags: np.ndarray) -> dict[str, np.ndarray]:
        x, h, t, g, of, weight, z = kept
        d = (y - label) / len(y)
        dz = d[:, None] * self.o
        dw = (dz[of] * h).sum(1)
        dl = weight * (dw - np.add.reduceat(weight * dw, bags)[of])
        dt, dg = dl[:, None] * self.a * g * (1 - t * t), dl[:, None] * self.a * t * g * (1 - g)
        dh = (dz[of] * weight[:, None] + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ dl, "o": z.T @ d, "c": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Adam over mini-batches of documents in a seeded order. Without labels the model is its seeded start, whose
    scores are a half for want of evidence."""
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, WIDTH))
    model = Model(p, x.mean(0), x.std(0) + 1e-2)
    if len(bags) == 0:
        model.o[:] = 0
        return model
    rng = np.random.default_rng(p.seed)
    first, second, step = {n: 0.0 for n in Model.NAMES}, {n: 0.0 for n in Model.NAMES}, 0
    for _ in range(p.epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            own = order[i : i + 64]
            rows = np.concatenate([bags[j] for j in own]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[j]) for j in own[:-1])])
            y, kept = model.forward(rows, starts)
            step += 1
            for n, grad in model.gradient(y, labels[own], kept, starts).items():
                grad = grad + p.decay * getattr(model, n)
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                setattr(model, n, getattr(model, n) - p.rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return model


def learn(docs: DataFrame, labels: DataFrame, p: Params) -> Model:
    """Fits on the documents that have a label and lie in the training folds, ``sample`` of them at most.

    Executors encode the sample; the driver gets features only, first the numbers of passages, then those of the
    documents that fit. Of rows that repeat a document the first by text counts.
    """
    marked = pick(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = marked.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    own = texts(docs).join(F.broadcast(train), "doc_id")  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, quality in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows.append((doc_id, quality, encode(text, p.passage).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "quality", "x"])

    with Cut(docs.sparkSession, "mil") as cut:
        # one row a document, so ``sample`` at most
        once = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
        encoded = cut.write(once.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary"), "bags")
        sizes = encoded.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.length("x") / (4 * WIDTH)).cast("long").alias("n")).collect()
        taken, total = [], 0
        for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
            total += r.n
            if total > p.passages and taken:
                break
            taken.append(r.doc_id)
        rows = (encoded if len(taken) == len(sizes) else encoded.where(F.col("doc_id").isin(taken))).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.quality for r in rows], float), p)


def scorer(model: Model, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(t, p.passage) for t in b.column(1).to_pylist()]
            if not bags:
                continue
            starts = np.cumsum([0, *map(len, bags[:-1])])
            y, kept = model.forward(np.concatenate(bags).astype(np.float64), starts)
            weight = np.maximum.reduceat(kept[5], starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y), pa.array([len(x) for x in bags], pa.int64()), pa.array(weight)], ["doc_id", "score", "n_passages", "top_attention"])

    return run


def quality(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_attention of every document.

    The score depends on the text alone. Rows whose fold is 0 are never learnt from. Labels other than 0 and 1
    and labels of unknown documents are left out; of several labels of a document the highest counts. A null or
    empty text is one passage of zeros; repeated rows give a row each; an empty table gives no rows.
    """
    p = params or Params()
    small_batches(docs.sparkSession)
    model = learn(docs, labels, p)
    out = texts(docs).mapInArrow(scorer(model, p), "doc_id long, score double, n_passages long, top_attention double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"), "n_passages", "top_attention")


def keep_good(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents that the classifier predicts as label 1, with all their columns, whatever their names. Null and empty
    texts are judged as one passage of zeros, each of repeated rows by itself; an empty table gives an empty table."""
    p = params or Params()
    small_batches(docs.sparkSession)
    model = learn(docs, labels, p)
    names, docs = docs.columns, told_apart(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(t or "", p.passage) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            if bags:
                y, _ = model.forward(np.concatenate(bags).astype(np.float64), np.cumsum([0, *map(len, bags[:-1])]))
                yield b.filter(pa.array(y >= p.threshold))

    return docs.mapInArrow(run, schema).toDF(*names)
