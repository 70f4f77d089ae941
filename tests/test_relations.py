"""Ranges of lines, frequent names, folded diagrams and the scanner, against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from stratum.operators import chunk, diagram, graph, symbols

FUNCTION = "file_path string, name string, start_line int, end_line int, ord int"


@pytest.mark.parametrize("seed", range(3))
def test_enclosing_functions_match_a_scan_of_all(spark, seed):
    rng = random.Random(seed)
    functions = []
    for i in range(300):
        a = rng.randint(1, 200)
        functions.append((f"f{rng.randrange(3)}", f"n{i}", a, a + rng.choice([-1, 0, 0, 3, 20, 150]), rng.randrange(40)))
    functions += functions[:20] + [("f0", "none", None, 3, 1)]
    calls = [(f"f{rng.randrange(4)}", rng.randint(0, 230), i) for i in range(400)] + [("f0", None, 400), (None, 3, 401)]

    def caller(file, line):
        around = [(a, o, b, n) for f, n, a, b, o in functions if f == file and None not in (a, line) and a <= line <= b]
        return min(around)[3] if around else "<module>"

    got = graph.enclosing(spark.createDataFrame(calls, "file_path string, line int, i int"), spark.createDataFrame(functions, FUNCTION), size=16)
    assert {r.i: r.caller_name for r in got.collect()} == {i: caller(f, x) for f, x, i in calls} and got.count() == len(calls)


def test_a_file_of_100000_functions_is_many_keys_of_bounded_lists(spark):
    n = 100_000
    i = F.col("id").cast("int")
    functions = spark.range(n).select(F.lit("big.ts").alias("file_path"), F.concat(F.lit("n"), "id").alias("name"), (i * 3 + 1).alias("start_line"), (i * 3 + 3).alias("end_line"), i.alias("ord"))
    functions = functions.unionByName(spark.range(n).select(F.lit("min.js").alias("file_path"), F.concat(F.lit("m"), "id").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), i.alias("ord")))
    calls = spark.range(n).select(F.lit("big.ts").alias("file_path"), (i * 3 + 2).alias("line"), "id")
    got = graph.enclosing(calls.unionByName(spark.createDataFrame([("min.js", 1, -1)], calls.schema)), functions)
    assert got.where((F.col("id") >= 0) & (F.col("caller_name") != F.concat(F.lit("n"), "id"))).isEmpty()
    assert got.where("id = -1").first().caller_name == "m0"


@pytest.mark.parametrize("seed", range(3))
def test_tags_match_a_scan_of_all(spark, seed):
    rng = random.Random(seed)
    kinds = ["function", "method", "class", "import", "export", "call", "param"]
    found = []
    for i in range(200):
        a = rng.randint(1, 120)
        found.append((f"f{rng.randrange(3)}", rng.choice(kinds), f"n{rng.randrange(30)}", a, a + rng.choice([-2, 0, 0, 5, 60]), i))
    windows = [(f"f{f}", a, a + rng.choice([0, 15, 40]), a % 5 == 0, f"text {f} {a}") for f in range(4) for a in range(1, 120, 7)]
    windows += [windows[0], ("f1", None, 4, False, "no line"), (None, 1, 4, False, "no file")]

    def names(window, wanted):
        f, a, b, whole, _ = window
        met = [(o, k, n) for g, k, n, x, y, o in found if g == f and not whole and a is not None and x <= y and x <= b and y >= a]
        return [n for _, k, n in sorted(met) if k in wanted]

    table = spark.createDataFrame(windows, "file_path string, start_line int, end_line int, is_summary boolean, content string")
    out = chunk.tagged(table, spark.createDataFrame(found, "file_path string, kind string, name string, start_line int, end_line int, ord int"), size=8)
    got = sorted((str(tuple(r[c] for c in table.columns)), *(r[t] for t in chunk.TAGS)) for r in out.collect())
    assert got == sorted((str(w), *(names(w, kinds) for kinds in chunk.TAGS.values())) for w in windows)
    assert chunk.tagged(table.where("false"), out.limit(0).select("file_path", F.lit("").alias("kind"), F.lit("").alias("name"), "start_line", "end_line", F.lit(0).alias("ord"))).isEmpty()


def test_a_frequent_name_is_looked_up_where_its_calls_are(spark):
    calls = spark.range(6000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), F.col("id") % 50, F.lit(".ts")).alias("caller_file"), F.when(F.col("id") % 3 == 0, "log").when(F.col("id") % 3 == 1, "gone").otherwise(F.concat(F.lit("n"), F.col("id") % 400)).alias("callee_name"), "id")
    calls = calls.unionByName(spark.createDataFrame([("d1/x.ts", None, -1), (None, "log", -2)], calls.schema))
    functions = spark.createDataFrame([("d1/log.ts", "log", 5), ("d2/log.ts", "log", 3), ("d2/f9.ts", "log", 9), ("z/n.ts", "n2", 1), ("d0/n.ts", "n2", 7)], "file_path string, name string, ord int")
    imports = spark.createDataFrame([("d3/f3.ts", "log", "z/log.ts", 1)], "file_path string, name string, target string, ord int")
    rows = lambda df: sorted((r.id, r.callee_file) for r in df.collect())
    split, plain = graph.resolved(calls, functions, imports, share=20, least=10), graph.resolved(calls, functions, imports)
    assert rows(split) == rows(plain) and split.count() == 6002
    of = dict(rows(split))
    assert of[-1] == "<external>" and of[-2] == "d2/log.ts" and {of[i] for i in range(1, 6000, 3)} == {"<external>"}
    hot = graph.frequent(calls, ["callee_name"], 6002, share=20, least=10)
    assert {r.callee_name for r in hot.collect()} == {"log", "gone"}
    table = functions.groupBy(F.col("name").alias("callee_name")).agg(F.min("file_path").alias("f"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = graph.looked_up(calls, table, ["callee_name"], hot)
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        shuffled = calls.join(F.broadcast(hot), ["callee_name"], "left_anti")  # what is left to shuffle has no name of over a share
        assert shuffled.groupBy("callee_name").count().agg(F.max("count")).first()[0] <= 6002 // 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def edges_of(spark, rows):
    return spark.createDataFrame([(a, "f", b, "g", 1) for a, b in rows], "caller_file string, caller_name string, callee_file string, callee_name string, line int")


def test_diagrams_fold_until_they_fit(spark):
    rng = random.Random(3)
    path = lambda: f"{rng.choice('abc')}/{rng.choice('xyz')}/{rng.randrange(9)}.ts"
    rows = [(path(), rng.choice([path(), path(), path(), "<external>"])) for _ in range(900)] + [("main.ts", "a/x/1.ts"), ("a/x/1.ts", "top.ts")]
    edges = edges_of(spark, rows)
    up = lambda p, d: p if p == "<external>" else "/".join(p.split("/")[:-1][:d]) or "."

    def summed(key):
        out = {}
        for a, b in rows:
            out[key(a), key(b)] = out.get((key(a), key(b)), 0) + 1
        return out

    for key in (lambda p: p, lambda p: up(p, 2), lambda p: up(p, 1)):
        want = summed(key)
        lines = len({x for ab in want for x in ab}) + sum(a != b for a, b in want)
        got = {(r.a, r.b): r.n for r in graph_rows(diagram.folded(edges, lines))}
        assert got == want
        text = diagram.overview(diagram.folded(edges, lines)).first().diagram.split("\n")
        assert text[0] == "graph TD" and len(text) == lines + 1
    few = graph_rows(diagram.folded(edges, 6))
    assert sum(r.n for r in few) == len(rows) and {diagram.OTHERS} < {x for r in few for x in (r.a, r.b)} and diagram.sized(diagram.folded(edges, 6)) <= 6
    assert diagram.fitted(edges, 5000).first() == diagram.call_graph(edges).first()
    assert diagram.fitted(edges.limit(0), 5).first().diagram == "graph TD"
    files = edges.select(F.col("caller_file").alias("file_path")).distinct()
    imports = spark.createDataFrame([("a/x/1.ts", "b/y/2.ts"), ("a/x/1.ts", None)], "file_path string, target string")
    assert diagram.fitted_architecture(files, edges, imports, 5000).first() == diagram.architecture(files, edges, imports).first()
    folders = diagram.fitted_architecture(files, edges, imports, 40).first().diagram.split("\n")
    assert len(folders) <= 41 and '  a["a"]' in folders and '  root["root"]' in folders and not any("External" in x for x in folders)


def graph_rows(df):
    return df.collect()


def test_brackets_in_strings_and_comments_end_no_block():
    own = lambda code, language: [s for s in symbols.extract(code, language) if s[0] in ("function", "method", "class")]
    assert own("function a() {\n  // }\n  x = '}' + \"}\" + `}${ b('}') }}`;\n  /* } */\n  return y / 2 }\nfunction c() { }\n", "javascript") == [("function", "a", "", 1, 5), ("function", "c", "", 6, 6)]
    assert own("fn a() {\n /* /* } */ } */\n let c = '}'; let s = r\"}\\\"; let l: &'a str = x;\n}\nfn b<'a>(x: &'a str) { }\n", "rust") == [("function", "a", "", 1, 4), ("function", "b", "", 5, 5)]
    assert own('def a(\n    x,\n):\n    """\nclass No:\n"""\n    return 1\n\n\ndef b(): pass\n', "python") == [("function", "a", "", 1, 7), ("function", "b", "", 10, 10)]
    assert own('class A {\n  void a() {\n    String s = """\n}\n""";\n  }\n  int b(int x)\n  {\n    return 1;\n  }\n}\n', "java") == [("class", "A", "", 1, 11), ("method", "a", "A", 2, 6), ("method", "b", "A", 7, 10)]
    assert own('A::A(int x) : y(x) { }\nint f(int a)\n{\n  return R"x(} )" )x"[0];\n}\nint decl(int);\n', "cpp") == [("method", "A", "A", 1, 1), ("function", "f", "", 2, 5)]
    assert own("func (s *S[T]) M() {\n\tx := `}`\n}\nfunc F[T any](a T) { }\n", "go") == [("method", "M", "S", 1, 3), ("function", "F", "", 4, 4)]
    assert own("const f = (a) =>\n  g(a);\nconst h = x => x\nlet n = 1\n", "typescript") == [("function", "f", "", 1, 2), ("function", "h", "", 3, 3)]


def test_parameters():
    of = lambda code, language: [s[1] for s in symbols.extract(code, language) if s[0] == "param"]
    assert of("function f(a: Map<string, number>, { b, c }, d = [1, 2], ...e) {}", "typescript") == ["a", "{ b, c }", "d", "...e"]
    assert of("def f(self, a: dict[str, int] = {}, *, b=(1, 2), **kw): pass", "python") == ["self", "a", "*", "b", "**kw"]
    assert of("function f() {}\nclass A {\n  m(x) {\n  }\n}", "javascript") == [] and of("func f(a, b int, c string) {}", "go") == ["a", "b", "c"]


HOSTILE = ["{", "(", "`${", "const a = (", "'", "a<", "int ", " ", "\n", "/*", "import ", "int a::", "x ", "\\", "function f(", "class A {", "export {", "def f(", "r#\"", "impl<"]


@pytest.mark.parametrize("language", sorted(set(symbols.FAMILY)))
def test_odd_sources_take_no_long(language):
    assert symbols.extract("", language) == []
    for piece in HOSTILE:
        begun = time.time()
        symbols.extract(piece * (30_000 // len(piece)), language)
        assert time.time() - begun < 8, piece


def test_nothing_but_functions_in_a_row_grows_evenly():
    body = "function f{i}(a, b) {{\n  return g(a, '}}');\n}}\n"
    got = symbols.extract("".join(body.format(i=i) for i in range(5000)), "javascript")
    assert [s for s in got if s[0] == "function"] == [("function", f"f{i}", "", 3 * i + 1, 3 * i + 3) for i in range(5000)]
