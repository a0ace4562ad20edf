"""Command line of the engine."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from foliora import formatting
from foliora.errors import FolioraError
from foliora.settings import Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliora", description=__doc__)
    p.add_argument("--root", help="folder of the catalog and the indexes")
    p.add_argument("--json", action="store_true", help="compact JSON")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, /, *args: str, **options):
        s = sub.add_parser(command)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", **v)

    text, flag, number = {}, {"action": "store_true"}, {"type": int}
    add("file-import", "path", name=text)
    add("file-list")
    add("file-delete", "file_id")
    add("collection-create", "name", description={"default": ""})
    add("collection-list")
    add("collection-delete", "collection_id")
    add("registry-list")
    add("ingest", "file_id", "collection_id")
    add("de-ingest", "file_id", "collection_id")
    add("job-list")
    add("search", "query", "collection_id", top_k=number, strategy={"choices": ["vector", "keyword", "hybrid"]}, debug=flag)
    add("ask", "query", "collection_id", top_k=number, careful=flag)
    add("inspect")
    add("ready")
    add("evaluate", "cases", "collection_id", top_k=number, output={"default": "storage/eval/report.json"})
    return p


def run(engine, a: argparse.Namespace):
    match a.command:
        case "file-import":
            return engine.import_file(a.path, a.name)
        case "file-list":
            return engine.list_files()
        case "file-delete":
            return engine.delete_file(a.file_id)
        case "collection-create":
            return engine.create_collection(a.name, a.description)
        case "collection-list":
            return engine.list_collections()
        case "collection-delete":
            return engine.delete_collection(a.collection_id)
        case "registry-list":
            return engine.list_registry()
        case "ingest":
            return engine.ingest(a.file_id, a.collection_id)
        case "de-ingest":
            return engine.de_ingest(a.file_id, a.collection_id)
        case "job-list":
            return engine.list_jobs()
        case "search":
            return engine.search(a.query, a.collection_id, a.top_k, a.strategy, a.debug)
        case "ask":
            return engine.ask(a.query, a.collection_id, a.top_k, a.careful)
        case "inspect":
            state = engine.inspect()
            return {**state, "settings": dataclasses.asdict(state["settings"])}
        case "ready":
            return engine.ready()
        case "evaluate":
            from foliora.sources.loaders import read_cases, write_report

            _, report = engine.evaluate(read_cases(engine.spark, a.cases), a.collection_id, a.top_k)
            write_report(report, a.output)
            return report.first().asDict()


def as_text(a: argparse.Namespace, out) -> str:
    if a.command == "search":
        return formatting.results(a.query, out)
    if a.command == "ask":
        return formatting.answer(out)
    if isinstance(out, list):
        return formatting.records(out)
    return formatting.records([out]) if isinstance(out, dict) else "done"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from foliora.engine import Engine

    settings = Settings.from_environment()
    if a.root:
        settings = dataclasses.replace(settings, root=a.root)
    spark = SparkSession.builder.appName("foliora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(Engine(spark, settings), a)
    except FolioraError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, default=str, separators=(",", ":")) if a.json else as_text(a, out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
