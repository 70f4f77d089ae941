"""Command line: index, index-code, index-prs, index-vectors, query, status, standup, clear, diagram, diagrams, config, info."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict
from pathlib import Path

from stratum import config as settings
from stratum.sources.diagrams import Diagrams


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratum", description=__doc__)
    out.add_argument("--repo", default=".")
    out.add_argument("--store", default=".stratum")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("index", "index-code", "index-vectors", "status", "clear", "info"):
        sub.add_parser(name)
    sub.add_parser("index-prs").add_argument("pages")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("-k", type=int, default=10)
    sub.add_parser("standup").add_argument("--since", default="1 week ago")
    d = sub.add_parser("diagram")
    d.add_argument("kind", choices=["architecture", "callgraph", "commits", "prs"])
    d.add_argument("--start", nargs=2, metavar=("FILE", "NAME"))
    d.add_argument("--save")
    d.add_argument("--title", help="keeps the diagram among the saved ones")
    s = sub.add_parser("diagrams", help="lists saved diagrams, or shows or deletes one")
    s.add_argument("name", nargs="?")
    s.add_argument("--delete", action="store_true")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "set", "reset"])
    c.add_argument("values", nargs="*", help="name=value")
    return out


def configure(at: Path, action: str, values: list[str]) -> settings.Config:
    current = settings.load(str(at), {}) if action != "reset" else settings.Config()
    if action == "set":
        current = current.with_values(dict(v.split("=", 1) for v in values))
    if action != "show":
        at.parent.mkdir(parents=True, exist_ok=True)
        settings.save(str(at), current)
    return current


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    at = Path(a.store) / "config.json"
    if a.command == "config":
        print(json.dumps(asdict(configure(at, a.action, a.values)), indent=2))
        return 0
    if a.command == "info":
        print(parser().format_help())
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("stratum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from stratum.plans.engine import Engine

    engine = Engine(spark, a.store, settings.load(str(at)))
    if a.command == "index":
        print(engine.index_repository(a.repo), "commits")
    elif a.command == "index-code":
        print(engine.index_code(a.repo))
    elif a.command == "index-prs":
        print(engine.index_pulls(a.pages), "pull requests")
    elif a.command == "query":
        print(engine.query(a.question, top_k=a.k, repo=a.repo).text)
    elif a.command == "status":
        print(engine.status().first().asDict())
    elif a.command == "standup":
        print(engine.summarize_recent(a.repo, a.since))
    elif a.command == "clear":
        engine.clear_index()
    elif a.command == "index-vectors":
        print(", ".join(engine.index_vectors()) or "all tables are small")
    elif a.command == "diagrams":
        saved = Diagrams(str(Path(a.store) / "diagrams"))
        if a.name:
            print(("deleted" if saved.delete(a.name) else "no such diagram") if a.delete else saved.load(a.name))
        else:
            print("\n".join(f"{d['name']}  {d['kind']}  {d['title']}" for d in saved.list()))
    else:
        out = engine.diagram(a.kind, a.repo, tuple(a.start) if a.start else None)
        if a.title:
            print(Diagrams(str(Path(a.store) / "diagrams")).save(a.kind, a.title, out))
        if a.save:
            Path(a.save).write_text(out + "\n")
        print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
