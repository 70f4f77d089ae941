"""Changed files into a store: their chunks, symbols and edges, for runs and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import text
from stratum.operators import chunk, embed, graph, symbols
from stratum.sources.store import Change


def update_code(into: Change, paths: DataFrame, files: DataFrame, make: Callable[[], embed.Embedder], summaries: bool = False, extractor: symbols.Extractor = symbols.extract) -> None:
    """Replaces what the store has of the files in ``paths`` (file_path) by that of ``files`` (file_path, content), the ones that are still there.

    Only these files are parsed. Their symbols go into a table, by which the call edges that they may have changed, of whichever
    files, are resolved anew; all others stay, co-change edges too.
    """
    paths = paths.select("file_path").distinct()
    before = into.read("symbols")
    fresh = "symbols" not in into.contents["tables"]
    into.replace_files(paths, symbols.symbols(files, extractor), "symbols")
    now = into.read("symbols")
    own = now.join(paths, "file_path", "left_semi")
    tagged = chunk.tagged(chunk.windows(files, summaries=summaries).drop("content_hash"), own)
    body = text.code_text(*(F.col(c) for c in ("file_path", "language", "start_line", "end_line", "content", "functions", "classes", "imports", "exports", "is_summary")))
    into.replace_files(paths, embed.embedded(tagged.withColumn("text", body), make=make).drop("text"))
    old = into.read("call_graph")
    calls = graph.call_edges(now) if fresh else graph.updated_edges(old, before, now, paths)
    edges = calls.unionByName(old.where("edge_type <> 'call'"), allowMissingColumns=True)
    if "call_graph" in into.contents["tables"] or not edges.isEmpty():
        into.create("call_graph", edges)
