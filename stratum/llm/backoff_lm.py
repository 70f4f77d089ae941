"""Language-model scores by a weighted backoff automaton whose n-gram counts stay distributed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.chunks import Chunk, ascending, bucket_bits, cells, compiled, inner, mixed, pack, unpack
from stratum.llm.common import Cut, fold, small_batches, texts

#: Tokens that no word can be, as words hold no white space; their ordinals in a chunk.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(w) >> 16) for w in (b" start", b" end"))


@dataclass(frozen=True)
class Params:
    """order: longest n-gram. add: what each word's count gets more in unigrams. prior: for orders 2 and up, the
    weight in tokens of the shorter context's estimate. chunk_chars: text of one chunk of documents. bucket: distinct
    n-grams of chunks, summed over the chunks, that a bucket holds at most, about. segment: tokens of a long document
    that are traversed in step with others."""

    order: int = 3
    add: float = 0.5
    prior: tuple[float, ...] = (2000.0, 10.0)
    chunk_chars: int = 4_500_000
    bucket: int = 3_000_000
    segment: int = 512


class Tokens:
    """The tokens of a chunk's documents, each document's words and one end, as ordinals: 0 is the start, 1 the end."""

    def __init__(self, c: Chunk, order: int) -> None:
        self.lengths = c.lengths + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.ones(int(self.lengths.sum()), np.int32)
        last = np.zeros(len(self.flat), bool)
        last[self.starts + c.lengths] = True
        self.flat[~last] = c.flat.astype(np.int32) + 2
        self.hashes = np.concatenate((np.array([START, END]), c.hashes))
        self.train = np.repeat(c.flag, self.lengths)
        first = np.zeros(len(self.flat), bool)
        first[self.starts] = True
        #: before[j]: the ordinal j + 1 places back, the start token before the first.
        self.before = []
        for _ in range(order - 1):
            back = self.before[-1] if self.before else self.flat
            self.before.append(np.where(first, np.int32(0), np.concatenate((back[:1], back[:-1]))))
        self.order = order

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n-gram that ends at each token; its top bits name the bucket."""
        h = mixed(self.hashes[self.flat] + np.uint64(n))
        for j in range(n - 1):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.before[j]])
        return h


def words_of(bits: int):
    """(bucket, blob) of the distinct hashes of a chunk's training words, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                t = Tokens(Chunk.load(blob), 1)
                keys = np.unique(mixed(t.hashes[np.unique(t.flat[t.train])] + np.uint64(1)))
                rows = [(i, pack(ascending(inner(keys[x:y], bits)))) for i, x, y in cells(keys, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["bucket", "blob"])

    return run


def distinct(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.cumsum(unpack(x)[0]) for x in table.column("blob").to_pylist()])
    return pa.table({"n": pa.array([len(np.unique(keys))], pa.int64())})


CELL = pa.schema([("n", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])


def requests(p: Params, bits: int):
    """The cells of each chunk: its n-grams and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = Tokens(Chunk.load(blob), p.order)
                for n in range(1, p.order + 1):
                    keys, place = np.unique(t.grams(n), return_inverse=True)
                    counts = np.bincount(place[t.train], minlength=len(keys)).astype(np.uint32)
                    rows = [(n, i, chunk, pack(ascending(inner(keys[x:y], bits)), counts[x:y])) for i, x, y in cells(keys, bits)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CELL)], CELL.names)

    return run


def replies(table: pa.Table) -> pa.Table:
    """Sums a bucket's counts over all chunks, and tells each cell what the others have of its own n-grams, in order."""
    got = [unpack(x) for x in table.column("blob").to_pylist()]
    sizes = [len(k) for k, _ in got]
    keys = np.concatenate([np.cumsum(k) for k, _ in got])
    counts = np.concatenate([c for _, c in got])
    del got
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
    sums = np.add.reduceat(counts, first)
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(sums, np.diff(first, append=len(keys))) - counts
    edges = np.cumsum([0, *sizes])
    small = np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64
    blobs = [pack(total[x:y].astype(small)) for x, y in zip(edges, edges[1:])]
    return pa.table([table.column("n"), table.column("bucket"), table.column("chunk"), pa.array(blobs, pa.binary())], schema=CELL)


class Automaton:
    """States are the contexts that training saw; a state has arcs for the words seen after it, each with the
    smoothed probability of its n-gram, and one failure arc to the context without its first word, with the
    weight of what the state leaves to words it never saw. The root has an arc for every word.

    With c for counts and m for an order's prior, P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), h' the shorter
    context, so the failure weight is m / (c(h) + m); P sums to one over the known words and one unknown word.
    """

    def __init__(self, t: Tokens, places: list[np.ndarray], counts: list[np.ndarray], tokens: int, words: int, p: Params) -> None:
        known = np.zeros(len(t.hashes), np.int64)
        known[t.flat] = counts[0][places[0]]
        self.known = known
        self.unigram = np.log10((known + p.add) / (tokens + p.add * (words + 1)))
        ends = np.array([known[1]])  # the start stands before as many tokens as there are training documents
        # States by number: the root, then the contexts of one word, then of two, and so on.
        fail, weight = [np.array([-1])], [np.array([0.0])]
        state = np.zeros(len(t.flat), np.int32)  # of the context before each token, of the order at hand
        arc_state, arc_word, arc_logp, arc_at = [], [], [], []
        shorter = 10.0 ** self.unigram[t.flat]
        self.after = np.zeros(len(t.hashes), np.int64)  # the root's next states
        total, contexts = 1, None
        for n in range(2, p.order + 1):
            if n == 2:
                label = t.before[0]
                seen = known.copy()
                seen[0] = ends[0]
            else:
                # the context of n - 1 words before a token is the n - 1-gram that ends one token earlier
                moved = np.concatenate(([0], places[n - 2][:-1])) + 1
                label = np.where(t.before[0] == 0, 0, moved)
                seen = np.concatenate((ends, counts[n - 2]))
            live = seen > 0
            number = np.where(live, total + np.cumsum(live) - 1, -1).astype(np.int32)
            before, state = state, number[label]
            fail.append(np.zeros(int(live.sum()), np.int64))
            has = state >= 0
            fail[-1][state[has] - total] = np.maximum(before[has], 0)
            m = p.prior[min(n - 2, len(p.prior) - 1)]
            weight.append(np.log10(m / (seen[live] + m)))
            c = counts[n - 1][places[n - 1]]
            prob = np.where(has, (c + m * shorter) / (seen[label] + m), shorter)
            at = np.empty(len(counts[n - 1]), np.int64)  # a token at which each distinct n-gram ends
            at[places[n - 1][::-1]] = np.arange(len(t.flat))[::-1]
            at = at[has[at] & (counts[n - 1] > 0)]
            arc_state.append(state[at])
            arc_word.append(t.flat[at])
            arc_logp.append(np.log10(prob[at]))
            arc_at.append((n, at))
            shorter, total = prob, total + int(live.sum())
            if n == 2:
                self.after = np.maximum(number, 0)
                self.after[1] = 0
            self.start = max(0, int(number[0]))
            contexts = state  # of the longest order so far
        self.fail, self.weight = np.concatenate(fail), np.concatenate(weight)
        # an arc leads to the longest context that is a state: the one before the next token
        following = np.concatenate((contexts[1:], [0])) if contexts is not None and len(contexts) else np.zeros(len(t.flat), np.int64)
        lower = self.after[t.flat]
        target = np.where((following > 0) & (t.flat != 1), following, lower)
        if p.order == 1:
            self.start = 0
        state_, word_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (arc_state, arc_word))
        logp = np.concatenate(arc_logp) if arc_logp else np.zeros(0)
        to = np.concatenate([target[i] if n >= p.order - 1 else lower[i] for n, i in arc_at]) if arc_at else np.zeros(0, np.int64)
        keys = state_.astype(np.int64) << 32 | word_
        by = np.argsort(keys)
        self.keys, self.word, self.logp, self.to = keys[by], word_[by], logp[by], to[by]
        #: a state's arcs are those from row[state] to row[state + 1], in order of their words
        self.row = np.concatenate(([0], np.cumsum(np.bincount(state_, minlength=total))))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of one next word for each of many states, and the states after it."""
        logp, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            s, w = state[left], word[left]
            root = s == 0
            if root.any():
                here = left[root]
                logp[here] += self.unigram[w[root]]
                to[here] = self.after[w[root]]
                left, s, w = left[~root], s[~root], w[~root]
                if not len(left):
                    break
            at, end = self.row[s], self.row[s + 1]
            hit = end > at
            hit[hit] = self.word[at[hit]] == w[hit]
            many = np.flatnonzero(~hit & (end - at > 1))
            if len(many):  # any but the first of several arcs
                found = np.minimum(np.searchsorted(self.keys, s[many].astype(np.int64) << 32 | w[many]), len(self.keys) - 1)
                at[many] = found
                hit[many] = (self.word[found] == w[many]) & (found < end[many]) & (found >= self.row[s[many]])
            good = left[hit]
            logp[good] += self.logp[at[hit]]
            to[good] = self.to[at[hit]]
            left, s = left[~hit], s[~hit]
            logp[left] += self.weight[s]
            state[left] = self.fail[s]
        return logp, to

    def run(self, t: Tokens, p: Params) -> np.ndarray:
        """One left-to-right traversal of each document, all documents of the chunk in step. A long document goes in
        segments, each from the state that the order - 1 tokens before it lead to, which is the state carried there."""
        counts = -(-t.lengths // p.segment)
        doc = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(-np.minimum(p.segment, t.lengths[doc] - number * p.segment), kind="stable")
        doc, number = doc[order], number[order]
        starts, lengths = t.starts[doc] + number * p.segment, np.minimum(p.segment, t.lengths[doc] - number * p.segment)
        score, state = np.zeros(len(doc)), np.where(number == 0, self.start, 0)
        later = np.flatnonzero(number > 0)
        for j in range(min(p.order, p.segment + 1) - 1, 0, -1):
            _, state[later] = self.step(state[later], t.flat[starts[later] - j])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for i, n in enumerate(alive):
            logp, state = self.step(state[:n].copy(), t.flat[starts[:n] + i])
            score[:n] += logp
        return np.bincount(doc, score, len(counts))


def scored(p: Params, tokens: int, words: int):
    names = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([[]] * len(names), schema=pa.schema(names))
        c = Chunk.load(own.column("blob")[0].as_py())
        t = Tokens(c, p.order)
        counts, places = [], []
        order, bucket = np.array(back.column("n").to_pylist()), np.array(back.column("bucket").to_pylist())
        blobs = back.column("blob").to_pylist()
        for n in range(1, p.order + 1):
            keys, place = np.unique(t.grams(n), return_inverse=True)
            places.append(place.astype(np.int32))
            others = np.flatnonzero(order == n)
            counts.append(np.concatenate([unpack(blobs[i])[0] for i in others[np.argsort(bucket[others])]]).astype(np.int64) + np.bincount(place[t.train], minlength=len(keys)))
            del keys, place
        del blobs, back
        auto = Automaton(t, places, counts, tokens, words, p)
        base = np.add.reduceat(auto.unigram[t.flat], t.starts)
        known = np.add.reduceat((auto.known[t.flat] > 0).astype(np.int64), t.starts)
        ids = pa.array(c.ids, pa.int64(), mask=c.null)
        return pa.table([ids, ~c.flag, t.lengths, known, np.full(len(c.ids), tokens), base, auto.run(t, p)], schema=pa.schema(names))

    return run


def lm_scores(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Each task compiles what it reads into chunks of about ``chunk_chars``. A chunk sends its distinct n-grams,
    with their counts in training documents, to buckets by hash; a bucket sums them over all chunks and answers
    each chunk for its own n-grams only. The chunk builds its part of the automaton from the answers and
    traverses its documents. So no task and no driver ever holds the corpus's n-grams, a hot word is one entry
    of each chunk, texts aren't shuffled, and what travels grows with the distinct n-grams of chunks. The
    number of a bucket's entries is bounded, that of buckets grows.

    N-grams are known by their bucket and 40 bits of hash. Null and empty texts are one end token. Repeated rows count
    and are scored each; a null doc_id counts as the empty text in the fold. An empty table gives no rows.
    """
    p = params or Params()
    spark = docs.sparkSession
    small_batches(spark)
    cut = Cut(spark, "lm")
    chunks = cut.write(compiled(texts(docs).withColumn("flag", fold() != 1), p.chunk_chars), "chunks")
    # two numbers to the driver, then one
    n_words, n_docs = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    bits = bucket_bits(n_words + n_docs, p.bucket)
    held = chunks.select("blob").mapInArrow(words_of(bits), "bucket long, blob binary").groupBy("bucket").applyInArrow(distinct, "n long")
    words = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((c.lengths + 1)[c.flag].sum()) for c in map(Chunk.load, b.column(0).to_pylist())], pa.int64())], ["n"])

    tokens = chunks.select("blob").mapInArrow(trained, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cell = "n int, bucket long, chunk long, blob binary"
    asked = chunks.select("chunk", "blob").mapInArrow(requests(p, bits), cell)
    answered = cut.write(asked.groupBy("n", "bucket").applyInArrow(replies, cell), "answers", free=True)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(scored(p, tokens, words), out)
