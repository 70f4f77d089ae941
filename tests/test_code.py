"""Call graphs kept up to date by the files that change, against full builds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stratum import schemas
from stratum.operators import embed, graph, symbols
from stratum.plans.engine import Engine
from stratum.sources.code import update_code
from stratum.sources.store import Store
from stratum.streaming import ingest

EDGE = ["caller_file", "caller_name", "callee_file", "callee_name", "line"]


def source(rng, path, files):
    """A file with imports, functions and calls of a few names, so that names clash, and imports may mean a file or an index."""
    depth = path.count("/")
    out = []
    for other in rng.sample(sorted(files), min(2, len(files))):
        stem = other.rsplit(".", 1)[0].removesuffix("/index")
        out.append(f"import {{ n{rng.randrange(5)}, n{rng.randrange(5)} }} from './{'../' * depth}{stem}';")
    for _ in range(rng.randrange(3)):
        out += [f"export function n{rng.randrange(5)}(x) {{", f"  return n{rng.randrange(5)}(x);", "}"]
    out += [f"n{rng.randrange(6)}(1);" for _ in range(rng.randrange(3))]
    return "\n".join(out) + "\n"


NAMES = ["a.ts", "b.ts", "lib/c.ts", "lib/c/index.ts", "lib/d.ts", "x/e.ts", "x/lib/c.ts", "b/index.ts"]


def edges_of(df):
    return sorted(tuple(r[c] for c in EDGE) for r in df.where("edge_type = 'call'").collect())


def full(spark, files):
    return edges_of(graph.call_edges(symbols.symbols(spark.createDataFrame(sorted(files.items()), "file_path string, content string"))))


def test_updates_after_random_edits_equal_full_builds(spark, tmp_path):
    rng = random.Random(5)
    files, parsed = {}, []
    st = Store(spark, f"{tmp_path}/s", buckets=2)

    def edit():
        touched = set(rng.sample(NAMES, rng.randint(1, 3)))
        for name in touched:
            if name in files and rng.random() < 0.4:
                del files[name]
            else:
                files[name] = source(rng, name, set(files) | {rng.choice(NAMES)})
        return touched

    for name in NAMES[:5]:
        files[name] = source(rng, name, set(NAMES))
    touched = set(files)
    for _ in range(7):
        parsed.clear()
        with st.change() as change:
            there = spark.createDataFrame([(f, files[f]) for f in touched if f in files], "file_path string, content string")
            update_code(change, spark.createDataFrame([(f,) for f in touched], "file_path string"), there, embed.HashedWords)
        assert edges_of(st.read("call_graph")) == full(spark, files)
        assert {r.file_path for r in st.read("symbols").select("file_path").distinct().collect()} <= set(files)
        touched = edit()


def test_an_import_means_another_file_once_that_is_there(spark):
    files = {"a.ts": "import { f } from './b';\nf(1);\n", "b/index.ts": "export function f(x) {\n  return x;\n}\n", "z.ts": "function other(x) {\n  return x;\n}\n"}
    table = lambda fs: symbols.symbols(spark.createDataFrame(sorted(fs.items()), "file_path string, content string"))
    before = table(files)
    files["b.ts"] = "export function g(x) {\n  return x;\n}\n"  # takes the import, without defining the name
    now = table(files)
    changed = spark.createDataFrame([("b.ts",)], "file_path string")
    assert {(r.file_path, r.name) for r in graph.stale_calls(before, now, changed).collect()} == {("a.ts", "f")}
    assert edges_of(graph.updated_edges(graph.call_edges(before), before, now, changed)) == full(spark, files)


def test_unchanged_files_are_not_parsed(spark, tmp_path):
    import subprocess

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@e.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    body = lambda k: f"export function n{k}(x) {{\n  return n{(k + 1) % 4}(x);\n}}\n"
    for k in range(4):
        (repo / f"f{k}.ts").write_text(body(k))
    run("add", "-A")
    run("commit", "-q", "-m", "c")
    log = tmp_path / "parsed"
    log.mkdir()
    at = str(log)

    def extractor(content, language):
        import hashlib
        import pathlib

        pathlib.Path(at, hashlib.md5(content.encode()).hexdigest()).touch()
        return symbols.extract(content, language)

    e = Engine(spark, f"{tmp_path}/s", extractor=extractor)
    assert e.index_code(str(repo)) == {"new": 4} and len(list(log.iterdir())) == 4
    for p in log.iterdir():
        p.unlink()
    (repo / "f1.ts").write_text("export function m(x) {\n  return n0(x);\n}\n")
    (repo / "f3.ts").unlink()
    assert e.index_code(str(repo)) == {"changed": 1, "deleted": 1} and len(list(log.iterdir())) == 1
    files = {p.name: p.read_text() for p in repo.glob("*.ts")}
    assert edges_of(e.store.read("call_graph")) == full(spark, files)
    assert e.index_code(str(repo)) == {} and edges_of(e.store.read("call_graph")) == full(spark, files)


def test_stream_and_run_give_equal_tables(spark, tmp_path):
    rng = random.Random(9)
    streamed, whole = Store(spark, f"{tmp_path}/a"), Store(spark, f"{tmp_path}/b", buckets=3)
    files = {}
    for version in range(3):
        touched = rng.sample(NAMES, 4)
        rows = []
        for f in touched:
            files[f] = None if version and rng.random() < 0.3 else source(rng, f, set(NAMES)) + f"// {version}\n"
            rows.append((f, files[f], version))
        batch = spark.createDataFrame(rows, ingest.FILES)
        for _ in range(1 + (version == 1)):  # one batch comes twice
            ingest.upsert(streamed)(batch, version)
    there = spark.createDataFrame([(f, c) for f, c in files.items() if c is not None], "file_path string, content string")
    with whole.change() as change:
        update_code(change, there.select("file_path"), there, embed.HashedWords)
    assert edges_of(streamed.read("call_graph")) == edges_of(whole.read("call_graph")) != []
    for name in ("symbols", "code_files"):
        order = [c for c in schemas.CHUNKS.fieldNames() if c in streamed.read(name).columns] if name == "code_files" else streamed.read(name).columns
        rows = lambda st: sorted(map(str, st.read(name).select(*order).collect()))  # noqa: E731, B023
        assert rows(streamed) == rows(whole) and rows(whole)
    assert streamed.read("code_files").where(F.size("functions") > 0).count() > 0
