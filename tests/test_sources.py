"""Services, saved diagrams, pages of pull requests, lists of near vectors and sentence models, with stand-ins for the network."""

from __future__ import annotations

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum import providers
from stratum.operators import embed, search
from stratum.sources import pulls
from stratum.sources.diagrams import Diagrams


def test_diagrams_are_saved_listed_loaded_and_deleted(tmp_path):
    d = Diagrams(str(tmp_path / "d"))
    assert d.list() == []
    one, two = d.save("prs", "Pull / requests!", "graph LR\n  a --> b", 1.0), d.save("commits", "", "gitGraph", 2.0)
    assert [x["name"] for x in d.list()] == [two, one] and d.list()[1]["kind"] == "prs" and d.list()[1]["title"] == "Pull / requests!"
    assert d.load(one) == "graph LR\n  a --> b"
    (tmp_path / "d" / "plain.mmd").write_text("graph TD\nx")
    assert d.load("plain") == "graph TD\nx" and d.list()[-1]["name"] == "plain"
    assert d.delete(one) and not d.delete(one)
    with pytest.raises(ValueError):
        d.load("../etc/passwd")


def test_services_stream_and_wait():
    waits, seen = [], []
    answers = [(429, {"Retry-After": "3"}, [b"busy"]), (429, {}, [b"busy"]), (200, {}, [b'data: {"choices":[{"delta":{"content":"he"}}]}\n', b"\n", b'data: {"choices":[{"delta":{"content":"llo"}}]}\n', b"data: [DONE]\n"])]
    calls = []

    def fetch(url, headers, body):
        calls.append((url, headers, json.loads(body)))
        return answers[min(len(calls), 3) - 1]

    m = providers.ChatCompletions("http://x/v1/", "m", fetch, sleep=waits.append, key="k")
    assert m.send([{"role": "user", "content": "q"}], seen.append) == "hello" and seen == ["he", "llo"] and waits == [3.0, 4.0]
    assert calls[0][0] == "http://x/v1/chat/completions" and calls[0][1]["Authorization"] == "Bearer k" and calls[0][2]["stream"]
    assert m.available()
    bad = providers.ChatCompletions("http://x", "m", lambda *_: (401, {}, [b"no"]))
    assert not bad.available()
    with pytest.raises(providers.ModelError):
        bad.send([])
    busy = providers.ChatCompletions("http://x", "m", lambda *_: (429, {}, [b"no"]), sleep=waits.append)
    with pytest.raises(providers.ModelError):
        busy.send([])
    local = providers.LocalChat("http://y", "m", lambda url, h, b: (200, {}, [b'{"models":[{"name":"a"}]}'] if url.endswith("tags") else [b'{"message":{"content":"o"}}\n', b'{"message":{"content":"k"},"done":true}\n']))
    assert local.send([]) == "ok" and local.models() == ["a"]

    def gone(*_):
        raise OSError("refused")

    assert not providers.LocalChat("http://y", "m", gone).available()


@pytest.mark.parametrize("at_once", [1, 3])
def test_pages_are_fetched_until_nothing_is_new(spark, tmp_path, at_once):
    rows = [{"number": i, "title": f"t{i}", "body": "fixes #7", "state": "closed", "user": {"login": "u"}, "updated_at": f"2024-01-{28 - i:02d}T00:00:00Z", "created_at": "2023-01-01T00:00:00Z", "merged_at": None} for i in range(25)]

    def get(path):
        if "/issues/" in path:
            if path.endswith("/8"):
                raise OSError
            return {"title": "bug"}
        page = int(path.rsplit("page=", 1)[1])
        return rows[(page - 1) * 4 : page * 4]

    f = pulls.Fetcher(get, "o", "n", size=4, at_once=at_once)
    assert f.fetch(str(tmp_path / "all")) == 25 and len(list((tmp_path / "all").glob("page-*.json"))) == 7
    assert f.fetch(str(tmp_path / "new"), since="2024-01-18T00:00:00Z") == 11
    raw = pulls.read_pages(spark, str(tmp_path / "new"))
    assert sorted(r.number for r in raw.collect()) == list(range(11)) and raw.first().user == "u"
    assert f.titles([7, 8, 7]) == {7: "bug"}


def test_lists_of_near_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 16))
    rows = [(i, (middle[i % 12] + 0.25 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(2000, None), (2001, [1.0])]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    index = search.ListIndex.build(table, f"file://{tmp_path}/i", lists=16, sample=600)
    assert spark.read.parquet(f"file://{tmp_path}/i/rows").count() == len(rows)
    hits = 0
    for i in range(0, 1500, 75):
        want = {r.id for r in search.knn(table, rows[i][1], 10, ["id"]).collect()}
        got = index.search(rows[i][1], 10, ["id"], probes=4)
        hits += len(want & {r.id for r in got.collect()})
    assert hits >= 0.9 * 200
    assert search.ListIndex.build(table.limit(0), f"file://{tmp_path}/e").search([0.0] * 16, 3, ["id"], 2).count() == 0


def test_short_vectors_take_no_part(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])], "id long, vector array<double>")
    assert [r.id for r in search.knn(table, [1.0, 2.0], 5, ["id"]).collect()] == [1, 4]
    wide = table.select("id", F.concat("vector", F.array_repeat(F.lit(0.0), 200)).alias("vector"))
    assert [r.id for r in search.knn(wide, [1.0, 2.0] + [0.0] * 200, 5, ["id"]).collect()] == [1, 4]


def test_sentence_model_by_mean_of_tokens():
    session = SimpleNamespace(get_inputs=lambda: [SimpleNamespace(name="input_ids"), SimpleNamespace(name="attention_mask")], run=lambda _, feed: [np.stack([feed["input_ids"], np.ones_like(feed["input_ids"])], -1).astype(float)])
    tokenizer = SimpleNamespace(encode=lambda t: SimpleNamespace(ids=[len(w) for w in t.split()]))
    got = embed.SentenceModel(session=session, tokenizer=tokenizer)(["aa bbbb", "", "c"])
    assert np.allclose(got, np.array([[3, 1], [0, 1], [1, 1]]) / np.linalg.norm([[3, 1], [0, 1], [1, 1]], axis=1, keepdims=True))
