"""Command line: ``python -m sparkloom.cli graph query DIR 'MATCH ...'`` and the like.

A graph on disk is a folder with ``nodes`` and ``edges`` in JSON lines, as ``graph_json.write`` makes it, or a JSON file.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import GraphEngine
from .sources import graph_json, results
from .sources.vector_store import VectorStore


def load(spark: SparkSession, path: str) -> GraphEngine:
    engine = GraphEngine(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    old = fs.Path(path + ".old")
    if not store.exists(where) and store.exists(old):  # a save was broken off between its two renames
        store.rename(old, where)
    if not store.exists(where):
        return engine
    if store.getFileStatus(where).isFile():
        engine.import_json(path)
    elif store.exists(fs.Path(path, "nodes")):
        engine.import_json_lines(path)
    return engine


def save(engine: GraphEngine, path: str) -> None:
    """Writes the graph beside the old one, moves that away and then the new one in; ``load`` finds one of them at any time."""
    spark = engine.spark
    fs = spark._jvm.org.apache.hadoop.fs
    new, old, where = fs.Path(path + ".new"), fs.Path(path + ".old"), fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(new, True)
    graph_json.write(engine.catalog, path + ".new")
    store.mkdirs(new)  # a graph without nodes
    if store.exists(where):
        store.delete(old, True)
        store.rename(where, old)
    store.rename(new, where)
    store.delete(old, True)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkloom")
    top = out.add_subparsers(dest="command", required=True)
    stats = top.add_parser("stats", help="figures of a vector store")
    stats.add_argument("path")
    graph = top.add_parser("graph", help="property graphs").add_subparsers(dest="action", required=True)
    for name in ("stats", "create", "export", "import", "query", "reindex"):
        sub = graph.add_parser(name)
        sub.add_argument("path")
        if name == "query":
            sub.add_argument("query")
            sub.add_argument("--params", default="{}", help="a JSON object")
            sub.add_argument("--json", action="store_true")
        if name in ("import", "export"):
            sub.add_argument("file")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    if args.command == "stats":
        print(results.to_table(VectorStore(spark, args.path).get_stats()))
        return 0
    engine = load(spark, args.path)
    if args.action == "stats":
        print(json.dumps(engine.graph_stats(), indent=2))
    elif args.action == "create":
        save(engine, args.path)
    elif args.action == "query":
        before = engine.catalog.version
        df = engine.cypher(args.query, json.loads(args.params))
        print(results.to_json(df) if args.json else results.to_table(df))
        if engine.catalog.version != before:
            save(engine, args.path)
    elif args.action == "export":
        with open(args.file, "w", encoding="utf-8") as f:
            json.dump(engine.export_json(), f)
    elif args.action == "import":
        n, e = engine.import_json(args.file)
        save(engine, args.path)
        print(f"{n} nodes, {e} edges")
    elif args.action == "reindex":
        for label, prop in engine.reindex():
            print(f"{label}.{prop}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
