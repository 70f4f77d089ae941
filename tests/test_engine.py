"""The engine end to end on a small repository made here, and its parts that queries don't reach."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from stratum import cli, config
from stratum.functions import intent
from stratum.operators import search, symbols
from stratum.plans.engine import Engine, triage_files
from stratum.sources import git
from stratum.sources.store import Store
from stratum.streaming import ingest

A = "import { help } from './b';\nexport function run(x) {\n  return help(x);\n}\nclass Box {\n  open(y) {\n    run(y);\n  }\n}\n"
B = "export function help(x) {\n  return next(x);\n}\nfunction next(x) {\n  return x + 1;\n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (at / "src").mkdir()
    for i in range(5):
        (at / "src/a.ts").write_text(A + f"// {i}\n")
        (at / "src/b.ts").write_text(B + f"// {i}\n")
        (at / "yarn.lock").write_text(str(i))
        run("add", "-A")
        run("commit", "-q", "-m", f"change {i}, fixes #{i}")
    return str(at)


def test_git_source(spark, repo):
    log = git.read_log(spark, repo, page=2)
    assert log.rdd.getNumPartitions() == 3 and log.count() == 5
    rows = git.commit_rows(log).collect()
    assert len(rows) == 10 and {r.file_path for r in rows} == {"src/a.ts", "src/b.ts"}
    assert all(r.files_changed == ["src/b.ts" if r.file_path == "src/a.ts" else "src/a.ts"] for r in rows)
    head = git.git(repo, "rev-parse", "HEAD").strip()
    assert git.known(repo, head) and not git.known(repo, "0" * 40)
    assert git.read_log(spark, repo, since=git.git(repo, "rev-parse", "HEAD~2").strip()).count() == 2
    assert git.blame_line(repo, "src/a.ts", 1)["author"] == "Ann" and git.blame_line(repo, "none", 1) is None
    assert {r.file_path for r in git.read_files(spark, repo).collect()} == {"src/a.ts", "src/b.ts"}
    assert git.summary_log(spark, repo, "10 years ago").agg(F.sum("lines_changed")).first()[0] > 0
    assert git.scale(5001) == "large" and git.scale(5000) == "small" and git.count_commits(repo) == 5


def test_engine(spark, repo, tmp_path):
    e = Engine(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError):
        e.query("anything")
    assert e.index_repository(repo) == 5
    assert e.index_code(repo) == {"new": 2}
    assert e.index_code(repo) == {}
    pages = tmp_path / "pages"
    pages.mkdir()
    pull = {"number": 7, "title": "Add help", "body": "Closes #3", "state": "closed", "merged_at": "2024-01-05T00:00:00Z", "user": {"login": "ann"}, "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-05T00:00:00Z", "merge_commit_sha": git.git(repo, "rev-parse", "HEAD").strip()}
    (pages / "page-1.json").write_text(json.dumps([pull]))
    assert e.index_pulls(str(pages)) == 1 and e.index_pulls(str(pages)) == 1
    s = e.status().first()
    assert (s.commits, s.files, s.pulls) == (5, 2, 1)
    edges = {(r.caller_file, r.caller_name, r.callee_file, r.callee_name) for r in e.store.read("call_graph").where("edge_type = 'call'").collect()}
    assert {("src/a.ts", "run", "src/b.ts", "help"), ("src/b.ts", "help", "src/b.ts", "next"), ("src/a.ts", "open", "src/a.ts", "run")} <= edges
    assert e.store.read("call_graph").where("edge_type = 'co-change'").count() == 1
    a = e.query("how does the function next() work in src/b.ts: trace the code", now=F.lit("2024-02-01").cast("timestamp"), repo=repo, history=[{"role": "user", "content": "hi"}])
    assert a.intent == "implementation" and "src/b.ts" in a.files and "Question: how" in a.messages[-1]["content"] and a.messages[1]["content"] == "hi"
    assert "[STRUCTURE] File: src/b.ts" in a.messages[-1]["content"]
    h = e.query("why was this changed, who approved the pr", now=F.lit("2024-02-01").cast("timestamp"))
    assert h.intent == "historical" and any(r["type"] == "commit" for r in h.results)
    for kind, part in (("architecture", "src_a_ts --> src_b_ts"), ("callgraph", "subgraph"), ("commits", "gitGraph"), ("prs", "pr7")):
        assert part in e.diagram(kind, repo)
    assert "External" not in e.diagram("callgraph", start=("src/b.ts", "help"))
    assert "messages" in e.summarize_recent(repo, "10 years ago") and e.explain_line(repo, "src/b.ts", 1).text
    e.clear_index()
    assert not e.store.exists("commits") and e.store.load_state() == {}


def test_store_replaces_and_removes(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s", buckets=4)
    none = F.array().cast("array<string>")
    rows = lambda *x: spark.createDataFrame([(p, 1, c) for p, c in x], "file_path string, start_line int, content string").withColumns({"language": F.lit("x"), "end_line": F.lit(1), "is_summary": F.lit(False), "functions": none, "classes": none, "imports": none, "exports": none, "vector": F.array().cast("array<float>")})
    st.create("code_files", rows(("a", "1"), ("b", "1"), ("c", "1")).select(*st.read("code_files").columns))
    files = lambda *x: spark.createDataFrame([(p,) for p in x], "file_path string")
    st.replace_files(files("a", "d"), rows(("a", "2"), ("d", "1")))
    assert {(r.file_path, r.content) for r in st.read("code_files").collect()} == {("a", "2"), ("b", "1"), ("c", "1"), ("d", "1")}
    st.replace_files(files("b", "c", "d", "a"))
    assert st.read("code_files").count() == 0


def test_stream_of_files(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/s")
    inbox = tmp_path / "in"
    inbox.mkdir()
    body = "a line of some length\n" * 3
    put = lambda name, *rows: (inbox / name).write_text("\n".join(json.dumps(dict(zip(("file_path", "content", "version"), r))) for r in rows))
    put("1.json", ("a.ts", body, 1), ("b.ts", body, 1), ("a.ts", body + "more", 2))
    ingest.follow_files(spark, str(inbox), st, f"{tmp_path}/c").awaitTermination()
    assert {r.file_path: r.end_line for r in st.read("code_files").collect()} == {"a.ts": 4, "b.ts": 4}
    put("2.json", ("b.ts", None, 2), ("c.ts", body, 1))
    ingest.follow_files(spark, str(inbox), st, f"{tmp_path}/c").awaitTermination()
    assert {r.file_path for r in st.read("code_files").collect()} == {"a.ts", "c.ts"}


def test_symbols_of_languages():
    names = lambda code, lang, kind: [s[1] for s in symbols.extract(code, lang) if s[0] == kind]
    assert names("def f(x):\n  g(x)\n\nclass C:\n  def m(self):\n    pass\n", "python", "method") == ["m"]
    assert names("from .a import b as c, d\nimport os\n", "python", "import") == [".a", "os"] and names("from .a import b as c, d\n", "python", "import_name") == ["c", "d"]
    assert names("func (s *Srv) Run(x int) {\n}\nfunc main() {\n\tRun()\n}\n", "go", "method") == ["Run"]
    assert names("pub fn go_on(x: u8) {\n}\nstruct P {\n}\n", "rust", "function") == ["go_on"]
    assert names("public class K {\n  public int size(int a) {\n    return 1;\n  }\n}\n", "java", "method") == ["size"]
    assert names("int add(int a, int b) {\n  return a;\n}\n", "c", "function") == ["add"]
    assert names("const f = (x) => x;\nexport class Q {}\nmodule.exports.z = f;\n", "javascript", "export") == ["Q", "z"]
    assert symbols.extract("x", "cobol") == []


def test_intent_probabilities(spark):
    rows = spark.createDataFrame([("the method",), ("the method of a class",), ("why when who the method",), ("issue",)], "question string")
    got = [(r.intent, round(r.p_implementation, 3), round(r.p_historical, 3)) for r in intent.classify(rows).collect()]
    assert got[0][:2] == ("implementation", 0.322) and got[1][:2] == ("implementation", 0.473) and got[2][0] == "historical" and got[2][2] == 0.582 and got[3][0] == "historical"
    assert intent.budgets(5, "general") == {"code": 20, "commit": 10, "pr": 5} and intent.budgets(5, "debugging", large=True) == {"code": 40, "commit": 40, "pr": 20}


def test_triage_and_lists(spark):
    assert triage_files(spark, "file: a/b.ts\nfile: ../x\nfile: /etc/x\nother\nfile:  c.go ") == ["a/b.ts", "c.go"]
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "id int, vector array<float>")
    centres = [[0.0, 0.0], [6.0, 2.0], [3.0, 1.0]]
    lists = search.assign_lists(v, centres)
    exact = [r.id for r in search.knn(v, [2.0, 1.0], 8, ["id"]).collect()]
    some = [r.id for r in search.probe(lists, [2.0, 1.0], 8, ["id"], centres, 2).collect()]
    assert len(set(exact) & set(some)) >= 7


def test_config_and_cli(tmp_path, capsys):
    at = f"{tmp_path}/x"
    assert cli.main(["--store", at, "config", "set", "top_k=9"]) == 0 and '"top_k": 9' in capsys.readouterr().out
    assert config.load(f"{at}/config.json", {"STRATUM_COMMIT_DEPTH": "3"}) == config.Config(top_k=9, commit_depth=3)
    assert cli.main(["--store", at, "config", "reset"]) == 0 and config.load(f"{at}/config.json", {}) == config.Config()
    assert cli.main(["info"]) == 0


def test_imports_without_the_training_data_part():
    code = "import sys; sys.modules['stratum.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 60; print('fine')"
    out = subprocess.run(["python", "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert "fine" in out.stdout, out.stderr[-500:]


def test_budgets_of_many_questions_are_those_of_each(spark):
    rows = [(b, i, large, o) for b in (1, 5, 30) for i in ("general", "historical", "debugging") for large in (False, True) for o in (None, 0, 30)]
    df = spark.createDataFrame(rows, "base int, intent string, large boolean, override int")
    for r in df.withColumns(intent.neighbours(*(F.col(c) for c in df.columns))).collect():
        assert {k: r[k] for k in ("code", "commit", "pr")} == intent.budgets(r.base, r.intent, r.large, r.override)
