"""Versions of the store: readers during writes, writers that lose, changes that are cut off, growth, and exactly-once ingest."""

from __future__ import annotations

import os
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from stratum import schemas
from stratum.plans.engine import Engine
from stratum.plans.store_queries import stored
from stratum.sources import git
from stratum.sources.store import Conflict, Store
from stratum.streaming import ingest


def chunks(spark, *files):
    return stored(spark.createDataFrame([(f, text) for f, text in files], "file_path string, content string"), schemas.CHUNKS)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def contents(df):
    return {r.file_path: r.content for r in df.collect()}


def commit(repo, i, name="a.ts"):
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    if not (repo / ".git").exists():
        run("init", "-q", "-b", "main")
    (repo / name).write_text(f"export function f{i}(x) {{\n  return x + {i};\n}}\n")
    run("add", "-A")
    run("commit", "-q", "-m", f"change {i}")
    return run


def test_a_reader_sees_the_version_it_opened(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s", buckets=4)
    st.create("code_files", chunks(spark, *((f"f{i}", "old") for i in range(20))))
    reader = Store(spark, f"{tmp_path}/s")
    before = reader.read("code_files")
    with st.change() as change:
        change.replace_files(paths(spark, "f0", "f3", "f7"), chunks(spark, ("f0", "new"), ("g", "new")))
        change.state["step"] = 2
        # all is written, but no version names it yet; a store that is opened now neither sees nor disturbs it
        assert contents(Store(spark, f"{tmp_path}/s").read("code_files")) == {f"f{i}": "old" for i in range(20)}
    after = {f"f{i}": "old" for i in range(20) if i not in (0, 3, 7)} | {"f0": "new", "g": "new"}
    assert contents(before) == {f"f{i}": "old" for i in range(20)} and contents(reader.read("code_files")) == after
    assert reader.load_state() == {"step": 2}
    assert contents(Store(spark, f"{tmp_path}/s", version=1).read("code_files")) == contents(before)


def test_a_writer_that_lost_the_race_fails(spark, tmp_path):
    a, b = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    a.create("code_files", chunks(spark, ("x", "1")))
    with pytest.raises(Conflict), a.change() as slow:
        slow.append("code_files", chunks(spark, ("y", "slow")))
        b.append("code_files", chunks(spark, ("z", "fast")))
    assert contents(a.read("code_files")) == {"x": "1", "z": "fast"} and a.version() == 2
    a.append("code_files", chunks(spark, ("y", "again")))
    assert contents(b.read("code_files")) == {"x": "1", "z": "fast", "y": "again"}


def test_of_many_writers_at_once_each_version_has_one(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s")
    st.save_state(n=0)
    start, won, lost = threading.Barrier(6), [], []

    def write(k):
        own = Store(spark, f"{tmp_path}/s")
        change = own.change()
        start.wait()
        try:
            with change:
                change.state["n"] = k
            won.append(k)
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5 and st.version() == 2 and st.load_state() == {"n": won[0]}
    assert sorted(os.listdir(f"{tmp_path}/s/versions")) == ["1", "2"] and [x for x in os.listdir(f"{tmp_path}/s/versions/2") if not x.startswith(".")] == ["contents"]


def test_a_change_that_is_cut_off_leaves_no_trace(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s", buckets=4)
    st.create("code_files", chunks(spark, ("a", "old"), ("b", "old")))
    with pytest.raises(RuntimeError), st.change() as change:
        change.replace_files(paths(spark, "a"), chunks(spark, ("a", "new")))
        change.state["done"] = True
        raise RuntimeError("lost")
    assert contents(st.read("code_files")) == {"a": "old", "b": "old"} and st.load_state() == {} and st.version() == 1
    left = set(os.listdir(f"{tmp_path}/s/data"))
    st.vacuum()
    assert set(os.listdir(f"{tmp_path}/s/data")) == left  # it may be a writer's at work
    st.vacuum(grace=0)
    assert len(os.listdir(f"{tmp_path}/s/data")) == 1 and contents(st.read("code_files")) == {"a": "old", "b": "old"}
    st.replace_files(paths(spark, "a"), chunks(spark, ("a", "new")))
    st.replace_files(paths(spark, "a"), chunks(spark, ("a", "new")))
    assert contents(st.read("code_files")) == {"a": "new", "b": "old"}


def test_buckets_grow_and_only_touched_ones_are_written(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s", buckets=2, bucket_bytes=4000)
    rows = [(f"f{i}", f"{i} " * 30) for i in range(60)]
    st.create("code_files", chunks(spark, *rows))
    st.replace_files(paths(spark, "f1"), chunks(spark, ("f1", "x")))
    grown = st.contents()["tables"]["code_files"]["buckets"]
    assert grown > 2 and contents(st.read("code_files")) == dict(rows) | {"f1": "x"}
    roomy = Store(spark, f"{tmp_path}/s")
    before = set(roomy.parts("code_files"))
    roomy.replace_files(paths(spark, "f5"), chunks(spark, ("f5", "y")))
    assert len(before - set(roomy.parts("code_files"))) == 1 and contents(roomy.read("code_files")) == dict(rows) | {"f1": "x", "f5": "y"}
    roomy.append("code_files", chunks(spark, ("f5", "z")))
    assert roomy.read("code_files").where("file_path = 'f5'").count() == 2
    roomy.replace_files(paths(spark, *(f for f, _ in rows)))
    assert roomy.read("code_files").count() == 0


def test_clearing_leaves_nothing(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s")
    st.create("code_files", chunks(spark, ("a", "1")))
    st.save_hashes(spark.createDataFrame([("a", "h")], "file_path string, content_hash string"))
    st.save_state(x=1)
    st.clear()
    assert not st.exists("code_files") and st.load_state() == {} and st.load_hashes().count() == 0
    assert os.listdir(f"{tmp_path}/s/data") == [] and os.listdir(f"{tmp_path}/s/versions") == [str(st.version())]


def test_ingest_cut_off_anywhere_gives_no_duplicates(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    repo.mkdir()
    for i in range(3):
        run = commit(repo, i)
    e = Engine(spark, f"{tmp_path}/s")
    assert e.index_repository(str(repo)) == 3
    commit(repo, 3)
    real = e.store.versions.commit
    monkeypatch.setattr(e.store.versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        e.index_repository(str(repo))  # rows are written; neither they nor the state count
    monkeypatch.setattr(e.store.versions, "commit", real)
    assert e.store.read("commits").count() == 3
    for _ in range(2):
        assert e.index_repository(str(repo)) == 4 and e.store.read("commits").count() == 4
    run("commit", "-q", "--amend", "-m", "rewritten")
    run("reflog", "expire", "--expire=now", "--all")
    run("gc", "-q", "--prune=now")
    assert e.index_repository(str(repo)) == 4
    assert {r.message for r in e.store.read("commits").collect()} == {"change 0", "change 1", "change 2", "rewritten"}


def test_streamed_commits_come_exactly_once(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    repo.mkdir()
    for i in range(5):
        commit(repo, i)
    st, e = Store(spark, f"{tmp_path}/s"), Engine(spark, f"{tmp_path}/s")
    follow = lambda: ingest.follow_commits(spark, str(repo), st, f"{tmp_path}/c", e.commit_vectors, page=2).awaitTermination()
    messages = lambda: sorted(r.message for r in st.read("commits").collect())
    follow()
    assert messages() == [f"change {i}" for i in range(5)]
    commit(repo, 5)
    once = ingest.once

    def dying(*a):
        inner = once(*a)

        def run(batch, epoch):
            inner(batch, epoch)
            raise RuntimeError("lost after the version, before the stream's checkpoint")

        return run

    monkeypatch.setattr(ingest, "once", dying)
    with pytest.raises(Exception, match="lost"):
        follow()
    monkeypatch.setattr(ingest, "once", once)
    assert messages() == [f"change {i}" for i in range(6)]
    follow()
    commit(repo, 6)
    follow()
    assert messages() == [f"change {i}" for i in range(7)]
    assert git.follow_log(spark, str(repo)).isStreaming


def test_streamed_files_keep_their_symbols(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s")
    code = "import { g } from './b';\nexport function f(x) {\n  return g(x);\n}\n"
    batch = spark.createDataFrame([("a.ts", code, 1), ("b.ts", "function g(x) {\n  return x;\n}\n", 1), ("c.ts", code, 1), ("c.ts", None, 2)], ingest.FILES)
    for _ in range(2):
        ingest.upsert(st)(batch, 0)
    got = {r.file_path: r for r in st.read("code_files").collect()}
    assert set(got) == {"a.ts", "b.ts"} and got["a.ts"].functions == ["f"] and got["a.ts"].exports == ["f"] and got["b.ts"].functions == ["g"]
    assert st.read("code_files").where(F.size("vector") > 0).count() == 2
