"""Diagrams as text: files and their calls, functions, commits over time, pull requests and issues.

Each diagram is lines with an order, made in parallel; ``text_of`` joins them into one row. ``fitted`` folds what is too
large for one first.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum import scratch
from stratum.functions import paths
from stratum.functions.text import diagram_id, diagram_label
from stratum.schemas import EXTERNAL

# The colours of states.
STYLES = [
    "",
    "  classDef merged fill:#238636,color:#fff",
    "  classDef closed fill:#da3633,color:#fff",
    "  classDef open fill:#238636,color:#fff,stroke-dasharray: 5 5",
    "  classDef issue fill:#8957e5,color:#fff",
    "  classDef commit fill:#848d97,color:#fff",
]


def text_of(lines: DataFrame, head: str, tail: list[str] | None = None) -> DataFrame:
    """One row, ``diagram``, of lines (part, major, minor, line)."""
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "major", "minor", "line"))), lambda x: x.line), "\n").alias("b"))
    return body.select(F.concat_ws("\n", F.lit(head), F.when(F.col("b") != "", F.col("b")), *map(F.lit, tail or [])).alias("diagram"))


def rows(df: DataFrame, part: int, major: Column, minor: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), major.cast("string").alias("major"), minor.cast("string").alias("minor"), line.alias("line"))


def indented(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


def subgraphs(nodes: DataFrame, group: Column, title: Column, label: Column, part: int, node: Column) -> DataFrame:
    """A block for each group around the lines of its nodes."""
    keyed = nodes.select(group.alias("g"), title.alias("t"), node.alias("node"), label.alias("label")).distinct()
    blocks = keyed.select("g", "t").distinct()
    opening = rows(blocks, part, F.col("g"), F.lit("0"), indented("  subgraph ", diagram_id(F.col("g")), '["', diagram_label(F.col("t")), '"]'))
    inner = rows(keyed, part, F.col("g"), F.concat(F.lit("1"), F.col("node")), indented("    ", diagram_id(F.col("node")), '["', diagram_label(F.col("label")), '"]'))
    return opening.unionByName(inner).unionByName(rows(blocks, part, F.col("g"), F.lit("2"), F.lit("  end")))


def architecture(files: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Files by folder, an arrow for each pair of files with a call, a dashed one for pairs with an import only.

    ``imports`` is (file_path, target).
    """
    path = F.col("file_path")
    folder = paths.directory(path)
    boxes = subgraphs(files, F.when(folder == ".", "root").otherwise(folder), F.when(folder == ".", "root").otherwise(folder), paths.basename(path), 0, path)
    calls = edges.where((F.col("callee_file") != EXTERNAL) & (F.col("caller_file") != F.col("callee_file"))).select(F.col("caller_file").alias("a"), F.col("callee_file").alias("b")).distinct()
    more = imports.where("target is not null and target <> file_path").select(F.col("file_path").alias("a"), F.col("target").alias("b")).distinct().join(calls, ["a", "b"], "left_anti")
    arrow = lambda df, part, mark: rows(df, part, F.col("a"), F.col("b"), indented("  ", diagram_id(F.col("a")), f" {mark} ", diagram_id(F.col("b"))))
    return text_of(boxes.unionByName(arrow(calls, 1, "-->")).unionByName(arrow(more, 2, "-.->")), "graph TD")


def call_graph(edges: DataFrame) -> DataFrame:
    """Functions by file and the calls between them; callees outside the repository in a block of their own."""
    inside = F.col("callee_file") != EXTERNAL
    one = edges.select(F.col("caller_file").alias("f"), F.col("caller_name").alias("n"))
    two = edges.where(inside).select(F.col("callee_file").alias("f"), F.col("callee_name").alias("n"))
    nodes = one.unionByName(two).distinct()
    boxes = subgraphs(nodes, F.when(F.col("f") == ".", "root").otherwise(F.col("f")), paths.basename(F.col("f")), F.col("n"), 0, F.concat("f", F.lit("::"), "n"))
    outside = edges.where(~inside).select("callee_name").distinct()
    some = outside.limit(1)
    ext = rows(some, 1, F.lit("0"), F.lit("0"), F.lit('  subgraph ext_fns["External"]')).unionByName(rows(outside, 1, F.lit("1"), F.col("callee_name"), indented("    ", diagram_id(F.concat(F.lit("ext::"), "callee_name")), '["', diagram_label(F.col("callee_name")), '"]'))).unionByName(rows(some, 1, F.lit("2"), F.lit("0"), F.lit("  end")))
    target = F.concat(F.when(inside, F.col("callee_file")).otherwise("ext"), F.lit("::"), F.col("callee_name"))
    order = F.concat_ws("\0", "caller_file", "caller_name", "callee_file", "callee_name", F.lpad(F.col("line").cast("string"), 12, "0"))
    arrows = rows(edges, 2, order, F.lit(""), indented("  ", diagram_id(F.concat("caller_file", F.lit("::"), "caller_name")), " --> ", diagram_id(target)))
    return text_of(boxes.unionByName(ext).unionByName(arrows), "graph TD")


#: Lines that a diagram has at most.
LINES = 2000
OTHERS = "(others)"


def sized(pairs: DataFrame) -> int:
    """Lines of a drawing of pairs (a, b, n): one for each node, and for each pair of two."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    return nodes + pairs.where("a <> b").count()


def within(path: Column, depth: int) -> Column:
    """The folder of a path, or of a folder, that is ``depth`` steps from the top at most."""
    return F.when(path == EXTERNAL, path).otherwise(F.substring_index(path, "/", depth))


def folded(edges: DataFrame, lines: int = LINES) -> DataFrame:
    """a, b, n: calls summed between files, or between folders as deep as they can be if a drawing is to have ``lines`` lines at most.

    Each step sums up what the one before has written, so it reads less and less; steps are as many as folders are deep. Where the
    topmost folders are too many themselves, those with the fewest calls become one node, so the result is always within bounds.
    """
    spark = edges.sparkSession

    def written(pairs: DataFrame) -> DataFrame:
        at = scratch.folder(spark, "fold")
        pairs.write.parquet(at)
        return spark.read.schema("a string, b string, n long").parquet(at)

    summed = lambda pairs, of: written(pairs.groupBy(of("a").alias("a"), of("b").alias("b")).agg(F.sum("n").alias("n")))
    pairs = written(edges.groupBy(F.col("caller_file").alias("a"), F.col("callee_file").alias("b")).agg(F.count("*").alias("n")))
    if sized(pairs) <= lines:
        return pairs
    deep = lambda c: F.size(F.split(c, "/"))
    top = lambda c: F.when(F.col(c) == EXTERNAL, F.col(c)).otherwise(paths.directory(F.col(c)))
    pairs = summed(pairs, top)
    depth = pairs.agg(F.max(F.greatest(deep("a"), deep("b")))).first()[0]
    while sized(pairs) > lines and depth > 1:
        depth -= 1
        pairs = summed(pairs, lambda c, d=depth: within(F.col(c), d))
    if sized(pairs) <= lines:
        return pairs
    calls = pairs.select(F.explode(F.array("a", "b")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    kept = F.broadcast(calls.orderBy(F.desc("n"), "node").limit(max(isqrt(lines) - 1, 1)).select("node"))
    known = pairs.join(kept.withColumnRenamed("node", "a").withColumn("a_in", F.lit(True)), "a", "left").join(kept.withColumnRenamed("node", "b").withColumn("b_in", F.lit(True)), "b", "left")
    return summed(known.select(F.when(F.col("a_in"), F.col("a")).otherwise(OTHERS).alias("a"), F.when(F.col("b_in"), F.col("b")).otherwise(OTHERS).alias("b"), "n"), F.col)


def overview(pairs: DataFrame) -> DataFrame:
    """A diagram of pairs (a, b, n): arrows with numbers of calls; calls within a file or folder have none."""
    ids = lambda c: diagram_id(F.when(F.col(c) == EXTERNAL, "ext").otherwise(F.when(F.col(c) == ".", "root").otherwise(F.col(c))))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = F.when(F.col("node") == EXTERNAL, "External").when(F.col("node") == ".", "root").otherwise(F.col("node"))
    boxes = rows(nodes, 0, F.col("node"), F.lit(""), indented("  ", ids("node"), '["', diagram_label(label), '"]'))
    arrows = rows(pairs.where("a <> b"), 1, F.col("a"), F.col("b"), indented("  ", ids("a"), " -->|", F.col("n").cast("string"), "| ", ids("b")))
    return text_of(boxes.unionByName(arrows), "graph TD")


def fitted(edges: DataFrame, lines: int = LINES) -> DataFrame:
    """Functions and their calls while they fit into ``lines`` arrows, else files or folders and theirs."""
    if edges.limit(lines + 1).count() <= lines:
        return call_graph(edges)
    return overview(folded(edges, lines))


def fitted_architecture(files: DataFrame, edges: DataFrame, imports: DataFrame, lines: int = LINES) -> DataFrame:
    """Files, calls and imports while they fit into ``lines`` boxes and arrows, else folders, with numbers of both; files without any
    count for their folder."""
    more = imports.where("target is not null").select(F.col("file_path").alias("caller_file"), F.col("target").alias("callee_file"))
    inside = edges.where(F.col("callee_file") != EXTERNAL).select("caller_file", "callee_file")
    if files.limit(lines + 1).count() + inside.unionByName(more).distinct().limit(lines + 1).count() <= lines:
        return architecture(files, edges, imports)
    return overview(folded(inside.unionByName(more).unionByName(files.select(F.col("file_path").alias("caller_file"), F.col("file_path").alias("callee_file"))), lines))


def timeline(commits: DataFrame, limit: int = 30) -> DataFrame:
    """The latest distinct commits, in order of time."""
    once = commits.groupBy("hash").agg(F.max("date").alias("date"), F.min("message").alias("message")).orderBy(F.desc("date"), "hash").limit(limit)
    first = F.regexp_replace(F.substring(F.element_at(F.split("message", "\n"), 1), 1, 50), '"', "'")
    return text_of(rows(once, 0, F.date_format("date", "yyyyMMddHHmmss"), F.col("hash"), indented('  commit id: "', F.substring("hash", 1, 7), '" tag: "', first, '"')), "gitGraph")


def pull_flow(pulls: DataFrame) -> DataFrame:
    """Pull requests with the issues they resolve and the commits they were merged in."""
    number = F.lpad(F.col("pr_number").cast("string"), 12, "0")
    own = diagram_id(F.concat(F.lit("pr"), F.col("pr_number").cast("string")))
    quote = lambda c: F.regexp_replace(F.substring(c, 1, 40), '"', "'")
    style = F.when(F.col("state").isin("merged", "closed"), F.concat(F.lit(":::"), F.col("state"))).otherwise(":::open")
    heads = rows(pulls, 0, number, F.lit("0"), indented("  ", own, '["#', F.col("pr_number").cast("string"), ": ", diagram_label(quote(F.col("title"))), '"]', style))
    issues = pulls.select("pr_number", F.posexplode("linked_issues").alias("i", "issue")).withColumn("issue", F.trim("issue")).withColumn("of", F.regexp_extract("issue", r"#(\d+)", 1)).where("of <> ''")
    issue = F.concat(F.lit("issue"), F.col("of"))
    at = lambda k: F.concat(F.lit("1"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit(k))
    linked = rows(issues, 0, number, at("a"), indented("  ", issue, '["', diagram_label(quote(F.col("issue"))), '"]:::issue')).unionByName(rows(issues, 0, number, at("b"), indented("  ", own, " -->|resolves| ", issue)))
    merged = pulls.where("resolved_by <> ''")
    short = F.substring("resolved_by", 1, 7)
    commit = F.concat(F.lit("commit"), short)
    into = rows(merged, 0, number, F.lit("2a"), indented("  ", commit, '(("', short, '")):::commit')).unionByName(rows(merged, 0, number, F.lit("2b"), indented("  ", own, " -->|merged in| ", commit)))
    return text_of(heads.unionByName(linked).unionByName(into), "graph LR", STYLES)
