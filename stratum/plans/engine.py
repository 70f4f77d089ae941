"""The engine: indexing of a repository's history, sources and pull requests, and questions on them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.config import Config
from stratum.functions import intent, paths, text
from stratum.operators import budget, diagram, embed, expand, graph, prompt, rerank, search, symbols
from stratum.sources import git, lists, pulls
from stratum.sources.code import update_code
from stratum.sources.store import Store, changes

SYSTEM = "You answer questions about a software project from the snippets of its code and history given to you, and say so if they don't hold the answer."
MAX_READ = 12_000


class LanguageModel(Protocol):
    """What the engine asks of a language model; it runs on the driver, never in tasks."""

    def send(self, messages: list[dict], on_chunk: Callable[[str], None] | None = None) -> str: ...

    def available(self) -> bool: ...


class Stub:
    """Answers with the size of what it was sent."""

    def send(self, messages: list[dict], on_chunk: Callable[[str], None] | None = None) -> str:
        answer = f"{len(messages)} messages, {sum(len(m['content']) for m in messages)} characters"
        if on_chunk:
            on_chunk(answer)
        return answer

    def available(self) -> bool:
        return True


@dataclass
class Answer:
    text: str
    messages: list[dict]
    intent: str
    results: list[dict] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Callable[[], embed.Embedder] = embed.HashedWords, model: LanguageModel | None = None, extractor: symbols.Extractor = symbols.extract) -> None:
        self.spark, self.store, self.config = spark, Store(spark, root), config or Config()
        self.embedder, self.model, self.extractor = embedder, model or Stub(), extractor
        self.listeners: list[Callable[[Config], None]] = []

    def update_config(self, **values: object) -> None:
        self.config = self.config.with_values(values)
        for f in self.listeners:
            f(self.config)

    def on_config_changed(self, f: Callable[[Config], None]) -> None:
        self.listeners.append(f)

    # Indexing

    def index_repository(self, repo: str) -> int:
        """Commits into the store: all of them, or only those since the last run while its commit still exists.

        The commits and the hash up to which they are there become one version of the store, so a run that is cut off anywhere
        leaves nothing, and the next one finds what it has to do from what is there.
        """
        with self.store.change() as change:
            last = change.state.get("last_hash", "")
            if last and not git.known(repo, last):  # history was rewritten
                change.contents.update(tables={}, state={}, indexes={})
                last = ""
            new = bool(last) and "commits" in change.contents["tables"]
            head = git.git(repo, "rev-parse", "HEAD").strip()
            if not new or last != head:
                log = git.read_log(self.spark, repo, since=last if new else "", until=head if new else "", limit=self.config.commit_depth)
                (change.append if new else change.create)("commits", self.commit_vectors(log))
                change.state["last_hash"] = head
        self.store.vacuum()
        return self.store.read("commits").select("hash").distinct().count()

    def commit_vectors(self, log: DataFrame) -> DataFrame:
        """Rows of the table of commits of a log."""
        body = text.commit_text(F.col("hash"), F.col("author"), F.col("date").cast("string"), F.col("message"), F.col("file_path"), F.col("files_changed"), F.col("condensed_diff"))
        return embed.embedded(git.commit_rows(log).withColumn("text", body), make=self.embedder).drop("text")

    def index_code(self, repo: str, large: bool | None = None) -> dict[str, int]:
        """Chunks of new and changed files replace the old ones; deleted files go, and only what they change
        of the call edges is resolved anew. All of it is one version."""
        large = git.scale(git.count_commits(repo)) == "large" if large is None else large
        files = git.read_files(self.spark, repo).persist()
        try:
            with self.store.change() as into:
                hashed = files.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
                change = changes(hashed, into.read("file_hashes")).persist()
                counts = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
                if "symbols" not in into.contents["tables"]:  # all files are new to it
                    anew = hashed.select("file_path").unionByName(into.read("file_hashes").select("file_path")).distinct()
                    update_code(into, anew, files.select("file_path", "content"), self.embedder, large, self.extractor)
                elif counts:
                    there = files.join(change.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi")
                    update_code(into, change.select("file_path"), there.select("file_path", "content"), self.embedder, large, self.extractor)
                co = graph.co_change_edges(graph.co_change(into.read("commits"), F.current_timestamp()))
                edges = into.read("call_graph").where("edge_type = 'call'").unionByName(co, allowMissingColumns=True)
                if not edges.isEmpty():
                    into.create("call_graph", edges)
                into.create("file_hashes", hashed)
            self.store.vacuum()
            return counts
        finally:
            files.unpersist()

    def index_pulls(self, pages: str) -> int:
        with self.store.change() as change:
            raw = pulls.read_pages(self.spark, pages, change.state.get("last_fetched"))
            normal = pulls.normalised(raw)
            change.upsert_pulls(embed.embedded(normal.withColumn("text", pulls.embedding_text(normal)), make=self.embedder).drop("text"))
            latest = raw.agg(F.max("updated_at")).first()[0]
            if latest:
                change.state["last_fetched"] = str(latest)
        return self.store.read("pr_data").count()

    def index_vectors(self, least: int = search.INDEXED) -> list[str]:
        """Indexes the vectors of the tables that are large enough, or what has been added to them since."""
        return [name for name in ("commits", "code_files", "pr_data") if self.store.read(name).count() >= least and lists.CodeIndex(self.store, name).update()]

    def nearest(self, name: str, vector: list[float], k: int, key: list[str]) -> DataFrame:
        """The k nearest rows of a table, by its index where there is one."""
        if name in self.store.contents()["indexes"]:
            return lists.CodeIndex(self.store, name).search(vector, k, key)
        return search.knn(self.store.read(name), vector, k, key)

    def nearest_code(self, vector: list[float], k: int, folder: str | None) -> DataFrame:
        """Chunks from a folder, which are few enough to be searched whole, and from everywhere, by the index where there is one."""
        key = ["file_path", "start_line"]
        code = self.store.read("code_files")
        if not folder or "code_files" not in self.store.contents()["indexes"]:
            return search.scoped_and_global(code, vector, k, folder, key) if folder else self.nearest("code_files", vector, k, key)
        share = math.ceil(0.6 * k)
        for prefix in (folder, folder.rstrip("/").rpartition("/")[0]):
            inside = F.col("file_path").startswith(prefix)
            if prefix and not code.where(inside).isEmpty():
                return search.knn(code, vector, share, key, inside).unionByName(self.nearest("code_files", vector, k - share, key))
        return self.nearest("code_files", vector, k, key)

    def status(self) -> DataFrame:
        return self.store.status()

    def clear_index(self) -> None:
        self.store.clear()

    # Questions

    def candidates(self, question: str, now: Column, folder: str | None = None, top_k: int | None = None, large: bool = False) -> tuple[DataFrame, dict]:
        """The ranked candidates of a question, and what the question is after."""
        one = self.spark.createDataFrame([(question,)], "question string")
        weights = intent.classify(one).withColumn("anchor", intent.anchor(F.col("question"), now.cast("date"))).withColumns({"symbols": intent.symbols(F.col("question")), "files": intent.mentioned_files(F.col("question")), "synthesis": intent.wants_synthesis(F.col("question"))}).first().asDict()
        vector = embed.embed_one(question, self.embedder())
        k = intent.budgets(self.config.top_k, weights["intent"], large, top_k)
        code = self.store.read("code_files")
        commits, prs = self.store.read("commits"), self.store.read("pr_data")
        near = self.nearest_code(vector, k["code"], folder if large else None).dropDuplicates(["file_path", "start_line"])
        if weights["p_implementation"] > 0.4:
            tagged = search.knn(code, vector, k["code"], ["file_path", "start_line"], search.with_symbols(code)).withColumn("score", F.col("score") * rerank.BOOSTS["symbols"])
            near = rerank.not_yet(tagged, near, ["file_path", "start_line"])
        past = self.nearest("commits", vector, k["commit"], ["hash", "file_path"])
        asked = self.nearest("pr_data", vector, k["pr"], ["pr_number"])
        dated = {"code": near, "commit": past, "pr": asked.withColumn("date", F.coalesce("merged_at", "created_at"))}
        every = None
        for kind, df in dated.items():
            df = df.withColumn("type", F.lit(kind))
            every = df if every is None else every.unionByName(df, allowMissingColumns=True)
        out = rerank.rerank(every, now, *(F.lit(weights[c]) for c in ("w_commit", "w_code", "w_pr", "decay")), F.lit(weights["anchor"]).cast("timestamp"))
        is_code = F.col("type") == "code"
        if weights["intent"] == "overview":
            out = rerank.boost(out, "overview", rerank.documentation(F.col("type"), F.col("file_path")))
        if weights["p_historical"] > 0.3:
            chain = rerank.pull_chain(out.where("type = 'pr'").select("pr_number", "score", "resolved_by"), commits.drop("vector"), out.where("type = 'commit'").select("hash"))
            out = out.unionByName(chain.withColumn("type", F.lit("commit")), allowMissingColumns=True)
        if weights["p_implementation"] > 0.4:
            out = rerank.boost(out, "named", is_code & rerank.names_symbol(F.col("functions"), F.col("content"), weights["symbols"]))
            out = rerank.boost(out, "mentioned", is_code & rerank.mentions(F.col("file_path"), weights["files"]))
        return rerank.ranked(out, "type", "hash", "pr_number", "file_path", "start_line").persist(), weights

    def query(self, question: str, now: Column | None = None, history: list[dict] | None = None, folder: str | None = None, top_k: int | None = None, large: bool = False, on_chunk: Callable[[str], None] | None = None, repo: str | None = None) -> Answer:
        """Retrieves, reranks, expands, fills the budget, and asks the model. Needs indexed commits."""
        if not self.store.exists("commits"):
            raise ValueError("the repository is not indexed")
        now = F.current_timestamp() if now is None else now
        found, w = self.candidates(question, now, folder, top_k, large)
        edges, code = self.store.read("call_graph"), self.store.read("code_files")
        n_files, cap = expand.limits(w["intent"])
        top = expand.best_per_file(found, n_files, "start_line")
        impl = w["p_implementation"] > 0.4
        files = expand.files_to_expand(top, expand.anchors(graph.degrees(edges)) if impl else None, expand.mentioned(code, w["files"]) if impl and w["files"] else None)
        own = code.join(F.broadcast(files.select("file_path")), "file_path", "left_semi").drop("vector")  # a handful of files
        walked = expand.context(own.where(~F.col("is_summary")), w["symbols"] if impl else [])
        texts = expand.rendered(walked, found.where("type = 'code'"), cap, "forced").join(files, "file_path").withColumn("cost", F.length("text"))
        whole, code_budget, commit_budget = budget.split(w["code_ratio"])
        kept = {r.file_path: (r.place, r.text) for r in budget.expansions(texts, code_budget).where("kept").collect()}
        expanded = {p: t for p, (_, t) in sorted(kept.items(), key=lambda x: x[1][0])}
        first = self.spark.createDataFrame([(p,) for p in expanded], "file_path string").withColumn("is_expanded", F.lit(True))
        cost = rerank.snippet_chars(F.col("type"), F.col("message"), F.col("condensed_diff"), F.coalesce("files_changed", F.array().cast("array<string>")), F.col("content"), F.col("title"), F.col("description"), F.array_join(F.coalesce("linked_issues", F.array().cast("array<string>")), ", "))
        costed = found.withColumn("cost", cost).join(first, "file_path", "left").withColumn("expanded", (F.col("type") == "code") & F.coalesce("is_expanded", F.lit(False)))
        best = costed.where("expanded").groupBy("file_path").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("best"))
        costed = costed.join(best, "rank", "left").withColumn("taken", F.coalesce("best", F.lit(False)))
        commit_first = w["intent"] in ("historical", "debugging")
        filled = budget.fill(costed, code_budget, commit_budget, commit_first, sum(len(t) + budget.HEADER for t in expanded.values()))
        results = [r.asDict() for r in filled.where("place is not null").orderBy("place").collect()]
        present = {r["file_path"] for r in results if r["type"] == "code"}
        # files that are expanded without a candidate chunk are shown too
        results += [{"type": "code", "score": 0.0, "file_path": p, "language": "", "content": "", "start_line": 1, "end_line": 1} for p in expanded if p not in present]
        tree = prompt.file_tree(code).first()[0] or "" if w["intent"] in ("overview", "general") else ""
        numbered = edges.withColumn("ord", F.struct("caller_file", "line", "callee_name"))
        blocks = "\n\n".join(r.block for r in prompt.structure(first, numbered, now).orderBy("file_path").collect()) if expanded else ""
        message = prompt.assemble(question, results, expanded, tree, blocks, bool(w["synthesis"]))
        messages = [{"role": "system", "content": SYSTEM}, *self.trimmed(history or [], len(message)), {"role": "user", "content": message}]
        if w["synthesis"] and repo:
            messages = self.synthesis(question, results, expanded, tree, blocks, messages, repo)
        found.unpersist()
        return Answer(self.model.send(messages, on_chunk), messages, w["intent"], results, expanded)

    def trimmed(self, history: list[dict], used: int) -> list[dict]:
        if not history:
            return []
        rows = self.spark.createDataFrame([(i, m["role"], m["content"]) for i, m in enumerate(history)], "turn int, role string, content string")
        return [{"role": r.role, "content": r.content} for r in budget.history(rows, budget.PROMPT - len(SYSTEM) - used).orderBy("turn").collect()]

    def synthesis(self, question: str, results: list[dict], expanded: dict[str, str], tree: str, blocks: str, messages: list[dict], repo: str) -> list[dict]:
        """Lets the model name files it lacks, reads those that are safe, and asks again with them in front."""
        wanted = self.model.send([*messages, {"role": "user", "content": "List files you need to see, one a line, as 'file: path'."}])
        more = dict(expanded)
        for path in triage_files(self.spark, wanted):
            if path not in more and (body := self.file_text(path, repo)):
                more[path] = body[:MAX_READ]
        shown = {r["file_path"] for r in results if r["type"] == "code"}
        extra = [{"type": "code", "score": 999.0, "file_path": p, "language": "", "content": "", "start_line": 1, "end_line": 1} for p in more if p not in shown]
        return [*messages[:-1], {"role": "user", "content": prompt.assemble(question, extra + results, more, tree, blocks, True)}]

    def file_text(self, path: str, repo: str) -> str:
        """A file's chunks from the store, or else the file itself if it lies in the repository."""
        rows = self.store.read("code_files").where((F.col("file_path") == path) & ~F.col("is_summary")).select("content").orderBy("start_line").collect()
        if rows:
            return "\n".join(r.content for r in rows)
        root = Path(repo).resolve()
        at = (root / path).resolve()
        return at.read_text(errors="replace") if at.is_relative_to(root) and at.is_file() else ""

    def summarize_recent(self, repo: str, since: str = "1 week ago", limit: int = 200) -> str:
        log = git.summary_log(self.spark, repo, since, limit)
        top = [r.hash for r in prompt.largest_commits(log).collect()]
        diffs = self.spark.createDataFrame([(h, git.full_diff(repo, h)) for h in top], "hash string, diff string")
        digest = prompt.digest(log, diffs).first().digest
        return self.model.send([{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"Sum up the recent work:\n\n{digest}"}])

    def explain_line(self, repo: str, file: str, line: int) -> Answer | None:
        found = git.blame_line(repo, file, line)
        return self.query(f"Why was line {line} of {file} changed in commit {found['hash'][:8]} ({found['summary']})?", repo=repo) if found else None

    # Diagrams

    def diagram(self, kind: str, repo: str | None = None, start: tuple[str, str] | None = None, limit: int = 30) -> str:
        edges = self.store.read("call_graph")
        if kind == "architecture":
            files = self.store.read("code_files").select("file_path").distinct()
            found = symbols.symbols(git.read_files(self.spark, repo)) if repo else self.spark.createDataFrame([], symbols.SCHEMA)
            imports = graph.import_targets(found.where("kind = 'import'").select("file_path", F.col("name").alias("source")), files, graph.DIAGRAM_SUFFIXES)
            return diagram.fitted_architecture(files, edges, imports).first().diagram
        if kind == "callgraph":
            static = edges.where("edge_type = 'call'")
            if start:
                static = graph.touching(static, graph.closure(static, self.spark.createDataFrame([start], "file string, name string")))
            return diagram.fitted(static).first().diagram
        if kind == "commits":
            return diagram.timeline(self.store.read("commits"), limit).first().diagram
        if kind == "prs":
            return diagram.pull_flow(self.store.read("pr_data")).first().diagram
        raise ValueError(f"no diagram {kind!r}; there are architecture, callgraph, commits and prs")


def triaged(answer: Column, most: int = 5) -> Column:
    """Safe relative paths that an answer names, the first ones."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^file:\s*(.+)$"), F.lit(1)), lambda p: F.trim(p))
    return F.slice(F.filter(named, lambda p: paths.is_safe(p)), 1, most)


def triage_files(spark: SparkSession, answer: str, most: int = 5) -> list[str]:
    return spark.createDataFrame([(answer,)], "a string").select(triaged(F.col("a"), most).alias("p")).first().p
