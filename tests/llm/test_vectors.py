"""Prefix-sharing BPE, partial-distance clusters and tiled whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA
from tokenizers import Tokenizer

from stratum.llm import partial_distance, prefix_bpe, queries, whitening

ODD = "aaaabcdeinstheréüßÉŚİσΣΑ中文字́̈ﬁ①٣ 's'llthing’“”—\x1c\x1f\x85\xa0 ​　\x00_-#$\t\n\x0b12 𝔘😀½²ªµ"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, Vec_ID string"


def library():
    return Tokenizer.from_file(prefix_bpe.Params().bpe)


def test_ids_are_those_of_the_library_for_odd_and_long_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abinsthe") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 70)] + ["ab" * 20_000, "ing" * 333, "é" * 999, "中" * 5000, "", " \n\t", "x<|endoftext|>Y<|startoftext|><|endoftext|> <|END", "don't 'S 'LL can'T"]
    tokenizer = library()
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for p in (prefix_bpe.Params(), prefix_bpe.Params(nodes=50, pieces=20, slice=900, longest=4)):
        e = prefix_bpe.Encoder(p)
        got = [x for at in range(0, len(texts), 700) for x in e.batch(texts[at : at + 700]).to_pylist()]
        assert got == expected
        assert len(e.known) < p.pieces + 20_000
    names = pa.array(prefix_bpe.names(prefix_bpe.Params().bpe), pa.string())
    assert prefix_bpe.decoded(pa.array(expected, pa.list_(pa.int32())), names).to_pylist() == [tokenizer.decode(x, skip_special_tokens=False) for x in expected]


def test_shared_prefixes_are_encoded_once():
    trie = prefix_bpe.Trie(prefix_bpe.model(prefix_bpe.Params().bpe))
    asked = []
    last = trie.last
    trie.last = lambda word, end, *rest: asked.append(word[:end]) or last(word, end, *rest)
    words = {"something", "somethings", "someone", "some"}
    ids = dict(trie.encode(words, 256))
    inner = [x for x in asked if asked.count(x) > 1 and x.decode() not in words]
    assert not inner and len(trie.state) == len({w[:n] for w in words for n in range(1, len(w))})
    dict(trie.encode({"something", "sometime"}, 256))
    assert asked.count(b"somet") == 1 and len(ids) == 4
    whole = library()
    assert all(np.frombuffer(ids[w], np.int32).tolist() == whole.encode(w, add_special_tokens=False).ids for w in words)


def test_borders_stay_as_plain_merging_says():
    m = prefix_bpe.model(prefix_bpe.Params().bpe)

    def merged(symbols):
        while len(symbols) > 1:
            ranks = [m.order.get(p, prefix_bpe.NEVER) for p in zip(symbols, symbols[1:])]
            if (least := min(ranks)) == prefix_bpe.NEVER:
                break
            at = ranks.index(least)
            symbols[at : at + 2] = [made[least]]
        return symbols

    made = {r: i for i, r in enumerate(m.rank) if r >= 0}
    letters = lambda i: [i] if m.parts[i][0] < 0 else letters(m.parts[i][0]) + letters(m.parts[i][1])
    rng = random.Random(6)
    short = [i for x, i in m.inside.items() if len(x) < 4 and x.isascii()]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        if rng.random() < 0.2:
            b = a
        assert m.stays(a, b) == (merged(letters(a) + letters(b)) == [a, b])


def test_encoding_of_whole_documents(spark):
    tokenizer = library()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_prefix_bpe(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r, e in zip(rows, tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        assert got[r.doc_id].n_tokens == len(e.ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(tokenizer.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, "a", "b"), (1, "", "a", "b"), (None, "Ab " * 100_000, None, None), (2, "same", "", ""), (2, "same", "", "")], "doc_id long, text string, Text string, ids string")
    back = prefix_bpe.decode(prefix_bpe.encode(odd)).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.text[:9]) for r in back) == sorted([(1, 0, ""), (1, 0, ""), (0, 100_000, "ab</w> ab"), (2, 1, "same</w>"), (2, 1, "same</w>")])
    assert not prefix_bpe.encode(odd.where("false")).collect()
    lost = spark.createDataFrame([(1, None), (2, [320, 10**6, -1]), (3, [None, 320]), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in prefix_bpe.decode(lost).collect()} == {1: None, 2: "a</w>", 3: "a</w>", 4: ""}


def plain_clusters(rows, p):
    """rows: (vec_id, whole numbers)."""
    key = lambda r: (hashlib.sha256(f"{p.seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(rows, key=key)[: p.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(p.rounds):
        own = [near(v)[1] for _, v in rows]
        for k in set(own):
            mine = [v for (_, v), o in zip(rows, own) if o == k]
            centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [near(v) for _, v in rows]
    inertia = {k: sum(d for d, o in found if o == k) for _, k in found}
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return [(i, k, d, inertia[k], sum(inertia.values()), digest(k)) for (i, _), (d, k) in zip(rows, found)]


@pytest.mark.parametrize("large", [False, True])
def test_clusters_against_brute_force(spark, large):
    rng = random.Random(8)
    p = partial_distance.Params(dimensions=12, clusters=7, step=4)
    base = [[rng.gauss(0, 1) * (3 if d == 5 else 0.3) for d in range(12)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)] + [(900 + i, base[0]) for i in range(40)] + [(3, base[9]), (3, base[8]), (None, base[7]), (None, base[7])]
    rows += [(1000 + i, [0.0] * 11 + [x]) for i, x in enumerate([-1e-20, 0.001, -0.001])]
    if large:
        rows += [(2000, [1e9, -1e9] + [0.5] * 10), (2001, [3e6] * 12)]
    none = [(70, None), (71, base[1][:11]), (72, [*base[1], 0.0]), (73, [None, *base[1][1:]]), (74, [math.nan, *base[1][1:]]), (75, [-math.inf, *base[1][1:]]), (76, [1e30, *base[1][1:]]), (77, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + none], EMBEDDINGS).repartition(5)
    whole = [(i, [math.floor(p.scale * float(np.float32(x))) for x in v]) for i, v in rows]
    got = [tuple(r) for r in partial_distance.clusters(table, p).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(plain_clusters(whole, p), key=order)
    assert not partial_distance.clusters(table.where("false"), p).collect()
    assert {r.cluster for r in partial_distance.clusters(spark.createDataFrame([(i, base[i], 1, "x") for i in range(3)], EMBEDDINGS), p).collect()} == {0, 1, 2}


def test_abandoning_never_loses_the_nearest():
    rng = np.random.default_rng(3)
    for step in (1, 3, 8, 64):
        x, c = rng.integers(-5, 6, (300, 64)), rng.integers(-5, 6, (40, 64))
        c[7] = c[30] = x[5]
        own, far = partial_distance.nearest(x, c, rng.permutation(64), step)
        whole = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == whole.argmin(1)).all() and (far == whole.min(1)).all() and own[5] == 7


def whitening_table(spark, rng, n=300, d=20):
    mix = rng.normal(size=(d, d))
    base = (rng.normal(size=(n, d)) @ mix * 0.2).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(base)] + [(5000 + i, base[0].tolist(), 1, "x") for i in range(150)] + [(None, base[1].tolist(), 1, None), (3, base[2].tolist(), 1, None)]
    none = [(9001, None, 1, ""), (9002, [], 1, ""), (9003, [1.0] * (d + 1), 1, ""), (9004, [math.nan] * d, 1, ""), (9005, [None] * d, 1, ""), (9006, [math.inf] * d, 1, ""), (9007, [1e30] * d, 1, "")]
    return spark.createDataFrame(rows + none, EMBEDDINGS).repartition(4), [(i, v) for i, v, *_ in rows]


def test_whitening_against_brute_force(spark):
    table, rows = whitening_table(spark, np.random.default_rng(2))
    p = whitening.Params(tile=6, rows=37)
    x = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
    v = away.T @ away / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    got = whitening.whiten(table, p).collect()
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    plain = {}
    for i, a in x:
        d = np.array([float(Fraction(n * b - s, n)) for b, s in zip(a, sums)])
        plain.setdefault(i, []).append((sum((n * b - s) ** 2 for b, s in zip(a, sums)), d @ directions / np.sqrt(values)))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9
        assert any(r.deviation == far and math.isclose(abs(r.whitened), abs(w[r.component - 1]), rel_tol=1e-6, abs_tol=1e-7) for far, w in plain[r.vec_id])
    for k, of in by.items():  # one sign for all rows
        signs = {np.sign(r.whitened * plain[r.vec_id][0][1][k - 1]) for r in of if len(plain[r.vec_id]) == 1 and abs(r.whitened) > 1e-3}
        assert len(signs) == 1


def test_whitening_of_tables_without_variance(spark):
    table, _ = whitening_table(spark, np.random.default_rng(2), n=5, d=3)
    assert not whitening.whiten(table.where("false")).collect()
    assert not whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, "x") for i in range(9)], EMBEDDINGS)).collect()
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "") for i in range(9)], EMBEDDINGS)
    rows = whitening.whiten(flat).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 9 and math.isclose(rows[0].explained, 1.0) and rows[0].identity_error < 1e-9
    far = spark.createDataFrame([(i, [float(i) * 1e9, float(i % 3)], 0, "") for i in range(9)], EMBEDDINGS)
    sums = [sum(64 * int(np.float32(i * 1e9)) + 10**6 for i in range(9)), sum(64 * (i % 3) + 10**6 for i in range(9))]
    exact = {i: (9 * (64 * int(np.float32(i * 1e9)) + 10**6) - sums[0]) ** 2 + (9 * (64 * (i % 3) + 10**6) - sums[1]) ** 2 for i in range(9)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in whitening.whiten(far).collect())


def test_tiles_do_not_change_the_covariance(spark):
    table, _ = whitening_table(spark, np.random.default_rng(5), n=80, d=13)
    rows = whitening.scaled(table, whitening.Params())
    fits = [whitening.fitted(rows, whitening.Params(tile=t, rows=r)) for t, r in ((4, 9), (13, 1000), (1, 50))]
    assert all(np.allclose(f.values, fits[0].values, rtol=1e-10) for f in fits)
