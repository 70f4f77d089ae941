"""Texts for a prompt: file tree, structure of files, recent work, snippets and the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import text
from stratum.operators import graph
from stratum.schemas import EXTERNAL

TREE_CHARS = 4000


def file_tree(files: DataFrame, cap: int = TREE_CHARS) -> DataFrame:
    """One row, ``tree``: folders and files in order, indented by depth, cut at ``cap`` characters.

    Every prefix of every path is an entry; entries are distinct before they meet, in order of their segments. Each
    takes two characters at least, so no more than the first half as many as ``cap`` come together.
    """
    parts = files.select(F.split("file_path", "/").alias("p"))
    prefixes = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.slice("p", 1, n).alias("p"), (n < F.size("p")).alias("folder")))).alias("e"))
    entries = prefixes.groupBy("e.p").agg(F.max("e.folder").alias("folder"))
    line = F.concat(F.repeat(F.lit("  "), F.size("p") - 1), F.element_at("p", -1), F.when(F.col("folder"), "/").otherwise(""))
    tree = entries.orderBy("p").limit(cap // 2 + 2).select("p", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x.line), "\n").alias("tree"))
    return tree.select(F.when(F.length("tree") > cap, F.concat(F.substring("tree", 1, cap), F.lit("\n... [tree truncated]"))).otherwise(F.col("tree")).alias("tree"))


def structure(files: DataFrame, edges: DataFrame, now: Column, calls: int = 15, together: int = 5) -> DataFrame:
    """file_path, block: what each file calls, who calls it, and what changes along with it.

    ``edges`` has ``ord`` for the order of call edges. The files are a handful; edges are cut to theirs first.
    """
    own = F.broadcast(files.select("file_path").distinct())
    static = edges.where("edge_type <> 'co-change'")

    def names(end: str, other: str) -> DataFrame:
        label = F.concat(F.col(f"{other}_name"), F.lit(" ("), F.col(f"{other}_file"), F.lit(")"))
        met = static.join(own, F.col(f"{end}_file") == F.col("file_path")).groupBy("file_path", label.alias("label")).agg(F.min("ord").alias("ord"))
        # only so many labels of a file are ever gathered, however many it has
        first = met.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("ord", "label"))).where(F.col("n") <= calls)
        return first.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x.label), ", ").alias(f"{end}_list"))

    co = edges.where("edge_type = 'co-change'")
    cols = ["weight", "raw_count", "latest_hash", "latest_date", "earliest_hash", "earliest_date"]
    ends = F.explode(F.array(F.struct(F.col("caller_file").alias("file_path"), F.col("callee_file").alias("other")), F.struct(F.col("callee_file").alias("file_path"), F.col("caller_file").alias("other"))))
    both = co.select(ends.alias("e"), *cols).select("e.*", *cols).join(own, "file_path", "left_semi")
    top = both.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("weight"), "other"))).where(F.col("n") <= together)
    when = lambda tag, side: F.when(F.col(f"{side}_date").isNotNull(), F.concat(F.lit(f"    {tag}: "), text.relative_age(F.col(f"{side}_date"), now), F.lit(" ("), F.substring(f"{side}_hash", 1, 8), F.lit(') → "'), text.freshness(F.col(f"{side}_date"), now), F.lit('"')))
    line = F.concat_ws("\n", F.concat(F.lit("  - Evolutionary: "), F.col("other"), F.lit(" — "), F.col("raw_count").cast("string"), F.lit(" co-changes")), when("LAST MODIFIED", "latest"), when("LEGACY PEAK", "earliest"))
    evolved = top.withColumn("line", line).groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("evolved"))
    joined = files.select("file_path").distinct().join(names("caller", "callee"), "file_path", "left").join(names("callee", "caller"), "file_path", "left").join(evolved, "file_path", "left")
    some = joined.where(F.coalesce("caller_list", "callee_list", "evolved").isNotNull())
    return some.select("file_path", F.concat_ws("\n", F.concat(F.lit("[STRUCTURE] File: "), F.col("file_path")), F.concat(F.lit("  Calls: "), F.col("caller_list")), F.concat(F.lit("  Called by: "), F.col("callee_list")), F.col("evolved")).alias("block"))


def largest_commits(log: DataFrame, n: int = 4) -> DataFrame:
    """The commits of most changed lines, which a digest shows in full, with their place."""
    top = log.orderBy(F.desc("lines_changed"), "hash").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lines_changed"), "hash")))


def digest(log: DataFrame, diffs: DataFrame, cap: int = 4000) -> DataFrame:
    """One row, ``digest``: a line for each commit of a period, then the diffs of the largest."""
    line = F.concat(F.substring("hash", 1, 8), F.lit(" | "), F.col("author"), F.lit(" | "), F.col("date").cast("string"), F.lit(" | "), F.col("message"), F.lit(" | "), F.col("lines_changed").cast("string"), F.lit(" lines"))
    contents = log.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("date"), F.col("hash"), line.alias("line")))), lambda x: x.line), "\n").alias("contents"))
    shown = largest_commits(log).select("hash", "place").join(diffs, "hash")
    part = F.concat(F.lit("### "), F.substring("hash", 1, 8), F.lit("\n"), F.when(F.length("diff") > cap, F.concat(F.substring("diff", 1, cap), F.lit("\n... [diff truncated]"))).otherwise(F.col("diff")))
    bodies = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x.part), "\n\n").alias("bodies"))
    return contents.join(F.broadcast(bodies)).select(F.concat_ws("\n\n", "contents", F.when(F.col("bodies") != "", F.col("bodies"))).alias("digest"))  # two rows of totals


def stats(results: DataFrame, expanded: int = 0) -> DataFrame:
    """One row of counts by kind."""
    return results.agg(F.count_if(F.col("type") == "code").alias("code"), F.count_if(F.col("type") == "commit").alias("commits"), F.count_if(F.col("type") == "pr").alias("pulls")).withColumn("expanded", F.lit(expanded).cast("long"))


def anchors(edges: DataFrame, n: int = 3) -> DataFrame:
    """The most connected files, external names left out."""
    return graph.degrees(edges).where(F.col("file_path") != EXTERNAL).orderBy(F.desc("degree"), "file_path").limit(n)


def snippet(row: dict, index: int, expanded: dict[str, str], shown: set[str]) -> str | None:
    """One result as text; a result of an expanded file is the whole file the first time and nothing after."""
    head = f"--- Retrieved Snippet {index} (score: {row['score']:.4f})"
    if row["type"] == "commit":
        lines = [f"{head} [COMMIT] ---", f"[COMMIT: {row['hash'][:8]}] Author: {row['author']} | Date: {row['date']}", f"[MESSAGE]: {row['message']}"]
        lines += [f"[FILE]: {row['file_path']}"] * bool(row["file_path"])
        lines += [f"[OTHER FILES]: {', '.join(row['files_changed'] or [])}"] * bool(row["files_changed"])
        lines += [f"[DIFF]:\n{row['condensed_diff']}"] * bool(row["condensed_diff"])
    elif row["type"] == "pr":
        lines = [f"{head} [PR] ---", f"[PR #{row['pr_number']}] {row['title']} | State: {row['state']} | Author: {row['author']}"]
        lines += [f"[DESCRIPTION]: {row['description'][:500]}"] * bool(row["description"])
        lines += [f"[LINKED ISSUES]: {', '.join(row['linked_issues'] or [])}"] * bool(row["linked_issues"])
        lines += [f"[MERGED]: {row['merged_at']}"] * bool(row["merged_at"])
        lines += [f"[MERGE COMMIT]: {row['resolved_by'][:8]}"] * bool(row["resolved_by"])
    else:
        path = row["file_path"]
        if path in shown:
            return None
        if path in expanded:
            shown.add(path)
            lines = [f"{head} [CODE – FULL FILE] ---", f"[CODE] File: {path} | Language: {row['language']}", expanded[path]]
        else:
            body = row["content"]
            lines = [f"{head} [CODE] ---", f"[CODE] File: {path} | Language: {row['language']} | Lines {row['start_line']}-{row['end_line']}", body if len(body) <= 3000 else body[:3000] + "\n... [truncated]"]
    return "\n".join(lines)


def assemble(question: str, results: list[dict], expanded: dict[str, str], tree: str = "", blocks: str = "", synthesis: bool = False, cap: int = 118_000) -> str:
    """The user's message. The question always stays; if the whole is too long, snippets are cut."""
    shown: set[str] = set()
    parts: list[tuple[bool, str]] = []
    order = sorted(range(len(results)), key=lambda i: {"code": 0, "pr": 1, "commit": 2}[results[i]["type"]]) if synthesis else range(len(results))
    for i in order:
        if out := snippet(results[i], len(parts) + 1, expanded, shown):
            parts.append((results[i]["type"] == "code", out))
    if synthesis:
        code, past = [x for c, x in parts if c], [x for c, x in parts if not c]
        sections = [f"=== SOURCE CODE ===\n\n{'\n\n'.join(code)}"] * bool(code) + [f"=== COMMITS AND PULL REQUESTS ===\n\n{'\n\n'.join(past)}"] * bool(past)
        snippets = "\n\n---\n\n".join(sections)
    else:
        snippets = "\n\n".join(x for _, x in parts)
    n = {k: sum(r["type"] == k for r in results) for k in ("code", "commit", "pr")}
    tail = f"[CONTEXT STATS] {n['code']} code snippets ({len(expanded)} full-file expansions), {n['commit']} commit records, {n['pr']} PR records.\n\n"
    tail += f"## Code structure\n\n{blocks}\n\n---\n\n" * bool(blocks) + f"## Files\n\n{tree}\n\n---\n\n" * bool(tree) + f"Question: {question}"
    room = max(0, cap - len(tail) - 100)
    if len(snippets) > room:
        snippets = snippets[:room] + "\n... [snippets truncated]"
    return f"Relevant snippets from the repository:\n\n{snippets}\n\n---\n\n{tail}"
