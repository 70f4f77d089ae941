"""Whole results of operators against plain Python, and the pipeline on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import corpus, docs, near_reference, prose, words

from stratum.llm import bbit, chaining, common, fertility, mil, mixing, packing, pii, secrets


def test_fertility_measures_by_the_tokenizers_themselves(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    p = fertility.Params()
    whole, model = Tokenizer.from_file(p.bpe), sentencepiece.SentencePieceProcessor(model_file=p.model)
    rng = random.Random(2)
    rows = [*corpus(4, 25), (500, prose(rng, 120)), (501, "same word " * 40 + prose(rng, 90)), (502, "\U00010380\U00010381 " * 70), (503, "zq" * 400 + " " + prose(rng, 60)), (504, "a b c d e f g h " * 9)]
    got = collections.defaultdict(list)
    for r in fertility.fertility(docs(spark, *rows)).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        t = t or ""
        ids = whole.encode(t, add_special_tokens=False).ids
        pieces = model.encode(re.sub("[\t\n\r]", " ", t))
        share = sum(model.is_byte(x) for x in pieces) / len(pieces) if pieces else 0.0
        n = len(ids)
        entropy = sum(-c / n * math.log2(c / n) for c in collections.Counter(ids).values()) if n else 0.0
        per = len(t) / n if n else 0.0
        r = next(r for r in got[i] if r.n_words == len(words(t)) and r.n_tokens == n)
        assert math.isclose(r.chars_per_token, per) and math.isclose(r.byte_share, share) and math.isclose(r.token_entropy, entropy, abs_tol=1e-9)
        b = p.bands["en"]
        ok = n > 0 and b.chars_per_token[0] <= per <= b.chars_per_token[1] and share <= b.byte_share and entropy >= b.evenness * math.log2(max(2, min(n, b.level)))
        assert r.kept == (ok and not r.base_failed) and (r.reason == "") == r.kept
    assert {got[i][0].reason for i in (501, 502)} <= {"base", "byte_share", "token_entropy", "chars_per_token"}


def test_bands_reject_each_for_its_reason():
    b = fertility.Band()
    assert fertility.judge(100, 4.0, 0.0, 6.0, b) == "" and fertility.judge(100, 0.9, 0.0, 6.0, b) == "chars_per_token"
    assert fertility.judge(100, 4.0, 0.9, 6.0, b) == "byte_share" and fertility.judge(100, 4.0, 0.0, 1.0, b) == "token_entropy" and fertility.judge(0, 0, 0, 0, b) == "empty"


def test_ownership_of_secrets_by_hand(spark):
    value, own, weak = "Zx81kLmQ02pTr7", "q9Wz7LmK3tYb1", "aaaaaaaa"
    opaque = "ZxQ9abTT81mnPq7LkWe33s"
    rows = [(i, f"token = {value}", "en", f"src{i % 5}") for i in range(40)]
    rows += [(100, f"secret: {own} and password={weak}", "en", "src9"), (101, f"secret: {own}", "de", "src9"), (102, f"key {opaque} here", None, "src8"), (103, f"toKen = {value}", "en", "src1"), (104, f"paſſword: {value}", "en", "src1")]
    rows += [(105, f"token = {value}", "en", None), (105, f"token = {value}", "en", None), (106, " ".join(f"token=abcdefg{k}" for k in range(9)) + f" token=abcdefgh{opaque}", "fr", "src7")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = collections.defaultdict(list)
    for r in secrets.secret_scan(table, secrets.Params(owners=3)).collect():
        got[r.doc_id].append(r)
    uses = sum(re.search("(token|secret|password) ?[:=]", t) is not None and value in t for _, t, *_ in rows)
    f = got[0][0].findings[0]
    assert (f.uses, f.owners, f.repositories, f.verdict) == (uses, 5, 5, "example")  # a null owner is none
    f = got[100][0].findings
    assert [(x.uses, x.owners, x.repositories, x.verdict) for x in f] == [(2, 1, 2, "live"), (1, 1, 1, "weak")]
    assert got[100][0].n_live == 1 and got[100][0].n_weak == 1 and got[0][0].n_example == 1 and got[0][0].n_live == 0
    assert got[102][0].spans == "opaque:4:26" and not got[103][0].n_assign and not got[104][0].n_assign and len(got[105]) == 2
    # a long run that a base span covers is no opaque one
    assert got[106][0].n_assign == 10 and "opaque" not in got[106][0].spans
    key = hashlib.blake2b(value.encode(), digest_size=20, key=b"stratum").hexdigest()
    assert got[0][0].findings[0].secret == key


def test_hot_keys_come_whole(spark):
    rows = spark.createDataFrame([(k, i) for i in range(900) for k in (["hot"] * (i % 3 > 0) + [f"k{i % 40}"])], "k string, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(common.joined(rows, table, "k", "n", most=100).collect()) == sorted(rows.join(table, "k").collect())


def test_sifting_keeps_all_that_is_wanted(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 7)
    got = {r.id for r in common.sifted(rows, wanted, "id", slots=64).collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 3000 and common.sifted(rows, wanted.limit(0), "id").count() == 0


def test_links_of_all_texts_of_a_repeated_id(spark):
    rng = random.Random(6)
    one, two = prose(rng, 100), prose(rng, 100)
    edit = lambda t: t.replace(t.split()[50], "edited", 1)
    rows = [(1, edit(one)), (2, edit(two)), (3, one), (3, two), (4, prose(rng, 80))]
    got = {r.doc_id: r.component_id for r in bbit.near_duplicates(docs(spark, *rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = sorted(r.doc_id for r in bbit.one_of_each(docs(spark, (7, one), (7, two), (7, one.upper())), bbit.Params(percent=80)).collect())
    assert kept == [7, 7]


def test_a_bucket_of_like_but_unlinked_texts_goes_in_blocks(spark):
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):  # pairs of about 0.6, with some links
        t = list(base)
        for j in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            t[j] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(t)))
    got = bbit.near_duplicates(docs(spark, *rows), bbit.Params(block=200, bucket=2, bands=40, rows=2)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_reference(rows, 85)


def test_passages_on_random_corpora_against_brute_force(spark):
    """Exact passages of 60 words or more that two documents share lead to a link of the later one."""
    rng = random.Random(21)
    pool = [[f"p{k}_{j}" for j in range(rng.choice([60, 80, 140]))] for k in range(12)]
    rows = []
    for i in range(70):
        t = []
        for _ in range(rng.randint(1, 4)):
            t += [f"u{i}_{len(t) + j}" for j in range(rng.randint(5, 60))]
            p = rng.choice(pool)
            a = rng.choice([0, 0, 0, len(p) // 2])
            t += p[a:]
        rows.append((i, " ".join(t)))
    rows += [(200, rows[3][1]), (200, "unlike " * 3), (3, rows[3][1])]
    found = collections.defaultdict(set)
    for r in chaining.shared_passages(docs(spark, *rows)).collect():
        found[r.doc_id].update(range(r.start, r.end))
        assert 100 * r.same >= 80 * max(r.end - r.start, r.other_end - r.other_start) - 1e-9 and r.other_id < r.doc_id
    seen: dict[tuple, int] = {}
    lost = total = 0
    for i, t in sorted(rows):
        w = t.split()
        for a in range(len(w) - 59):
            first = seen.setdefault(tuple(w[a : a + 60]), i)
            if first < i:
                total += 1
                lost += not set(range(a, a + 60)) & found[i]
    assert total > 500 and lost == 0


def test_pairs_that_earlier_documents_hide(spark):
    """24 documents hold 30 words each of a passage that two later ones share."""
    passage = [f"p{k}" for k in range(120)]
    fill = lambda i, n: [f"f{i}_{k}" for k in range(n)]
    rows = [(i, " ".join(fill(i, 30) + passage[4 * i : 4 * i + 30] + fill(-i - 1, 30))) for i in range(24)]
    rows += [(1000, " ".join(fill(1000, 40) + passage + fill(-1000, 9))), (1001, " ".join(fill(1001, 20) + passage + fill(-1001, 40)))]
    got = {(r.doc_id, r.other_id): (r.start, r.end) for r in chaining.shared_passages(docs(spark, *rows)).collect()}
    assert got == {(1001, 1000): (20, 140)}


def test_long_gaps_are_aligned_exactly():
    rng = random.Random(3)
    for _ in range(40):
        x, y = ([rng.randint(0, 6) for _ in range(rng.randint(0, 70))] for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert chaining.common(x, y) == table[-1, -1]


def test_values_that_a_base_check_refuses_are_never_taken_up(spark):
    assert all(map(pii.refused, ("7086638319846192", "1234 5678 9012 3456", "300.1.1.1", "+1 234 567")))
    assert not any(map(pii.refused, ("4111111111111111", "1.2.3.4", "8812734455", "(017) 5557714", "+1 234 567 8901", "AB1234567")))
    rows = [(i, f"user of: person{i}@mail.example, paid of 4111 1111 1111 1111") for i in range(40)]
    rows += [(50, "paid of 7086638319846192 and of 300.1.1.1 and user of 7086638319846193"), (51, "a piece of 12345678")]
    assert all(r.n_other == 0 for r in pii.personal_data(docs(spark, *rows)).collect())


def test_a_single_word_is_no_context(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 6)} of person{i}@mail.example {prose(rng, 6)}") for i in range(60)]
    rows += [(100, f"{prose(rng, 6)} of 1234567890 {prose(rng, 6)}")]
    assert all(r.n_other == 0 for r in pii.personal_data(docs(spark, *rows)).collect())


def test_bootstrapping_against_plain_rounds(spark):
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 4)} contact phone: +1 (017) 555-{7000 + i} thanks") for i in range(20)] + [(30 + i, f"user name: person{i}@mail.example please") for i in range(20)]
    rows += [(60, "contact phone: (017) 5557714 thanks"), (61, "user name: person_at_mail99 please"), (62, "serial number 8812734455 of"), (63, "contact phone: 99-88-77 okay"), (64, None), (65, "contact phone: +1 (017) 555-7000 thanks")]
    p = pii.Params()
    known, edges, spots = set(), set(), []
    batch = __import__("pyarrow").RecordBatch.from_pydict({"row": list(range(len(rows))), "doc_id": [i for i, _ in rows], "text": [t or "" for _, t in rows]})
    for b in pii.scan(iter([batch])):
        for doc_id, found in zip(b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            for f in found:
                edges |= {(x, f["value"]) for x in f["patterns"]}
                known |= {f["value"]} if f["kind"] else set()
                spots.append((doc_id, f))
    score = {v: float(v in known) for _, v in edges}
    for _ in range(p.rounds):
        by = collections.defaultdict(list)
        for x, v in edges:
            by[x].append(v)
        strong = {}
        for x, vs in by.items():
            sure = [v for v in vs if score[v] >= p.confidence]
            c = sum(score[v] for v in sure) / (len(vs) + p.smooth)
            if len(sure) >= p.support and c >= p.confidence:
                strong[x] = c
        of = collections.defaultdict(list)
        for x, v in edges:
            if x in strong and v not in known:
                of[v].append(strong[x])
        score |= {v: 1 - math.prod(1 - c for c in cs) for v, cs in of.items()}
    want = collections.defaultdict(set)
    for doc_id, f in spots:
        if f["kind"] or (score[f["value"]] >= p.confidence and any(x in strong and len(x.split()) == 3 for x in f["patterns"])):
            want[doc_id].add(f"{f['kind'] or 'other'}:{f['start']}:{f['end']}")
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, *rows)).collect()}
    assert {i: set(filter(None, r.spans.split(","))) for i, r in got.items()} == {i: want[i] for i, _ in rows}
    assert all(got[i].n_other == 1 for i in (60, 61, 63)) and got[62].n_other == 0


@pytest.mark.parametrize("mean", [2.5, 200.0, 201.0, 700.0])
def test_counts_are_poisson_at_any_mean(spark, mean):
    p = mixing.Params()
    n = 4000
    counts = spark.range(n).select(mixing.drawn(F.col("id").cast("string"), F.lit(mean), p).alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.skewness("n").alias("s")).first()
    assert abs(counts.m - mean) < 4 * math.sqrt(mean / n)
    assert abs(counts.v - mean) < 4 * math.sqrt((2 * mean**2 + mean) / n)
    assert abs(counts.s - 1 / math.sqrt(mean)) < 0.2


def test_high_rates_match_sql(spark, tmp_path):
    import duckdb
    from compare import plain, rows_of

    rows = [(i, f"t{i}", "en", f"s{i % 3}", 2) for i in range(30)] + [(1000, "rare", "en", "rare", 4), (1000, "rare", "en", "rare", 4), (None, "none", "de", None, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    p = mixing.Params(weights={"rare": 0.9}, other=0.1, total=40.0)
    got = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"), p)
    got = got.select("doc_id", "source", "lang", "n_chars", "copy", F.round("rate", 9).alias("rate"), "place", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(mixing.oracle(p))
    names = [d[0] for d in found.description]
    assert rows_of(names, found.fetchall()) == rows_of(got.columns, got.collect()) and plain(1.0) == "1"


def test_mixing_marks_sources_and_high_rates(spark):
    rows = [(i, f"t{i}", "en", None if i % 4 == 0 else f"s{i % 7}", "mine") for i in range(400)] + [(1000, "rare", "en", "rare", "mine")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy string")
    p = mixing.Params(weights={"rare": 0.9}, other=0.1, total=2.0)
    out = mixing.mix(table, p, marks=False)
    got = out.collect()
    assert out.columns == table.columns and all(r.copy == "mine" for r in got)
    n = sum(r.doc_id == 1000 for r in got)  # a mean of 721.8
    assert 580 <= n <= 860
    marked = mixing.mix(table, p)
    assert marked.columns == [*table.columns, "rate", "copy", "place"]
    salted = mixing.mix(table, mixing.Params(weights={"rare": 0.9}, other=0.1, total=2.0, broadcast_rows=2), marks=False)
    assert collections.Counter(r.doc_id for r in salted.collect()) == collections.Counter(r.doc_id for r in got)
    plan = mixing.mix(table, p)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan.split("BroadcastExchange")[0]


def test_forward_pass_by_hand():
    p = mil.Params(hidden=4, attention=3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, mil.WIDTH))
    m = mil.Model(p, x.mean(0), x.std(0) + 0.1)
    got, _ = m.forward(x, np.array([0, 2]))
    for bag, y in (((0, 1), got[0]), ((2, 3, 4), got[1])):
        hs, logits = [], []
        for i in bag:
            h = [math.tanh(sum(max(-6, min(6, (x[i, k] - m.mean[k]) / m.scale[k])) * m.w[k, j] for k in range(mil.WIDTH)) + m.b[j]) for j in range(4)]
            gate = lambda w, f: [f(sum(h[j] * w[j, a] for j in range(4))) for a in range(3)]  # noqa: E731, B023
            t, g = gate(m.v, math.tanh), gate(m.u, lambda z: 1 / (1 + math.exp(-z)))
            hs.append(h)
            logits.append(sum(t[a] * g[a] * m.a[a] for a in range(3)))
        weight = [math.exp(z) / sum(map(math.exp, logits)) for z in logits]
        z = [sum(w * h[j] for w, h in zip(weight, hs)) for j in range(4)]
        assert math.isclose(y, 1 / (1 + math.exp(-(sum(z[j] * m.o[j] for j in range(4)) + m.c[0]))))


def test_samples_end_at_whole_documents(spark):
    table = docs(spark, *[(i, prose(random.Random(i), 300)) for i in range(1, 40)], *[(1, prose(random.Random(1), 300))] * 5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taken = []
    old, mil.fit = mil.fit, lambda bags, y, p: taken.append([len(b) for b in bags]) or old(bags[:2], y[:2], mil.Params(epochs=1))
    try:
        mil.learn(table, labels, mil.Params(passages=23))
        mil.learn(table, labels, mil.Params())
    finally:
        mil.fit = old
    assert taken[0] == [5] * 4 and set(taken[1]) == {5} and len(taken[1]) > 20


def test_assignment_by_hand():
    p = packing.Params(length=8, linear=1.0, quadratic=1.0)
    # 9: a whole sequence and 1 left; then 7, 5, 3 and 1 by falling cost into two sequences of 8
    assert packing.assign([9, 7, 5, 3], p) == [[(0, 8, 0, 0), (8, 1, 1, 7)], [(0, 7, 1, 0)], [(0, 5, 2, 0)], [(0, 3, 2, 5)]]


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(60, 200)), rng.choice(["en", None]), rng.choice(["src0", "src1", None]), 5, "x", "y") for i in range(60)]
    rows += [(None, prose(rng, 90), "en", "src0", None, "x", "y"), (70, None, "en", "src0", 0, None, None), (71, "", None, None, 0, "x", "y"), (72, "w " * 20_000, "en", "src1", 9, "x", "y"), (3, rows[3][1], "en", "src0", 5, "x", "y"), (3, prose(rng, 99), "en", "src0", 5, "x", "y"), (80, f"{prose(rng, 80)} mail me@x.org", "en", "src0", 5, "x", "y")]
    table = spark.createDataFrame(rows if kind == "odd" else [], "doc_id long, text string, lang string, source string, n_chars long, copy string, words string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    n = out.count()
    assert n == 0 if kind == "empty" else n > 30
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = stage(spark, table, str(tmp_path))
        assert table.columns == before.columns
        table = spark.createDataFrame(table.collect(), before.schema)
    assert kind == "empty" or not table.where(F.col("text").contains("me@x.org")).count()


def test_tables_are_deleted_but_for_the_result(spark):
    import os

    table = docs(spark, *corpus(2, 20))
    before = set(common.LEFT)
    results = [f(table) for f in (bbit.near_duplicates, pii.personal_data, secrets.secret_scan)]
    for path in set(common.LEFT) - before:
        left = os.listdir(path.removeprefix("file://")) if os.path.isdir(path.removeprefix("file://")) else []
        assert all(x.startswith("result-") for x in left), left
    assert all(r.count() for r in results)
    with pytest.raises(ZeroDivisionError), common.Cut(spark, "broken") as cut:
        cut.write(table.select("doc_id"), "a")
        raise ZeroDivisionError
    assert not os.listdir(cut.root.removeprefix("file://"))
