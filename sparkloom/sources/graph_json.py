"""Graphs as JSON: nodes [{id, labels, properties, vector}] and edges [{source, target, type, properties}]."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from .catalog import Catalog
from .scratch import written


def value_type(x: Any) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.LongType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, (list, tuple)):
        kinds = [value_type(v) for v in x if v is not None]
        return T.ArrayType(_common(kinds) if kinds else T.StringType())
    if isinstance(x, dict):
        return T.StructType([T.StructField(k, value_type(v)) for k, v in x.items()])
    return T.StringType()


def _common(kinds: list[T.DataType]) -> T.DataType:
    from .catalog import common_type

    out: T.DataType = T.NullType()
    for k in kinds:
        out = common_type(out, k)
    return T.StringType() if isinstance(out, T.NullType) else out


def _fit(x: Any, kind: T.DataType) -> Any:
    if x is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(x)
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in x]
    if isinstance(kind, T.StructType):
        return {f.name: _fit(x.get(f.name), f.dataType) for f in kind.fields}
    return x


def literal(x: Any) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*[literal(v) for v in x])
    if isinstance(x, dict):
        return F.struct(*[literal(v).alias(k) for k, v in x.items()])
    return F.lit(x).cast("bigint") if isinstance(x, int) and not isinstance(x, bool) else F.lit(x)


def _frame(spark: SparkSession, fixed: list[tuple[str, T.DataType]], rows: list[list], props: list[dict]) -> DataFrame:
    keys = list(dict.fromkeys(k for p in props for k in p))
    kinds = {k: _common([value_type(p[k]) for p in props if p.get(k) is not None]) for k in keys}
    schema = T.StructType([T.StructField(n, t) for n, t in fixed] + [T.StructField(k, kinds[k]) for k in keys])
    return spark.createDataFrame([(*r, *[_fit(p.get(k), kinds[k]) for k in keys]) for r, p in zip(rows, props, strict=True)], schema)


def node_frame(spark: SparkSession, nodes: list[dict[str, Any]]) -> DataFrame:
    """The table of nodes given as objects; it has vectors if any of them does."""
    fixed: list[tuple[str, T.DataType]] = [("_id", T.StringType())]
    vectors = any(n.get("vector") for n in nodes)
    if vectors:
        fixed.append(("_vec", T.ArrayType(T.FloatType())))
    rows = [[n["id"], *([[float(x) for x in n["vector"]] if n.get("vector") else None] if vectors else [])] for n in nodes]
    return _frame(spark, fixed, rows, [n.get("properties") or {} for n in nodes])


def edge_frame(spark: SparkSession, edges: list[dict[str, Any]]) -> DataFrame:
    fixed = [("_eid", T.StringType()), ("_src", T.StringType()), ("_dst", T.StringType())]
    return _frame(spark, fixed, [[e["id"], e["source"], e["target"]] for e in edges], [e.get("properties") or {} for e in edges])


def properties_json(props: dict[str, T.DataType]) -> Column:
    """The properties that are not null, as JSON."""
    return F.to_json(F.struct(*[F.col(f"`{p}`").alias(p) for p in props])) if props else F.lit("{}")


def load(catalog: Catalog, graph: dict[str, Any] | str) -> tuple[Catalog, int, int]:
    """Nodes, then edges, under new ids; an edge with an unknown end is an error."""
    if isinstance(graph, str):
        if not graph.lstrip().startswith("{"):
            graph = "\n".join(r[0] for r in catalog.spark.read.text(graph, wholetext=True).collect()) if "://" in graph or os.path.exists(graph) else graph
        graph = json.loads(graph)
    ids: dict[str, str] = {}
    by_labels: dict[tuple[str, ...], list] = {}
    for n in graph.get("nodes", []):
        new = str(uuid.uuid4())
        if n.get("id") is not None:
            ids[n["id"]] = new
        by_labels.setdefault(tuple(n.get("labels", [])), []).append({**n, "id": new})
    by_type: dict[str, list] = {}
    for e in graph.get("edges", []):
        if e["source"] not in ids or e["target"] not in ids:
            raise GraphError(f"edge {e['source']} -> {e['target']} has an end that is no node of the graph")
        by_type.setdefault(e["type"], []).append({**e, "id": str(uuid.uuid4()), "source": ids[e["source"]], "target": ids[e["target"]]})
    for labels, nodes in by_labels.items():
        catalog = catalog.with_nodes(labels, node_frame(catalog.spark, nodes))
    for kind, edges in by_type.items():
        catalog = catalog.with_new_edges(kind, edge_frame(catalog.spark, edges))
    return catalog, sum(map(len, by_labels.values())), sum(map(len, by_type.values()))


def export(catalog: Catalog) -> dict[str, Any]:
    """The whole graph as one object, for graphs that fit the driver; ``write`` exports any graph."""
    nodes = [json.loads(r[0]) for t in catalog.nodes.values() for r in _node_json(t).toLocalIterator()]
    edges = [json.loads(r[0]) for t in catalog.edges for r in _edge_json(t).toLocalIterator()]
    return {"nodes": nodes, "edges": edges}


def _node_json(t) -> DataFrame:
    props = F.struct(*[F.col(f"`{p}`").alias(p) for p in t.props]) if t.props else F.create_map().cast("map<string,string>")
    vector = [F.col("_vec").alias("vector")] if t.has_vectors else []
    return t.df.select(F.to_json(F.struct(F.col("_id").alias("id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("labels"), props.alias("properties"), *vector)).alias("value"))


def _edge_json(t) -> DataFrame:
    props = F.struct(*[F.col(f"`{p}`").alias(p) for p in t.props]) if t.props else F.create_map().cast("map<string,string>")
    return t.df.select(F.to_json(F.struct(F.col("_src").alias("source"), F.col("_dst").alias("target"), F.lit(t.type).alias("type"), props.alias("properties"))).alias("value"))


def write(catalog: Catalog, folder: str) -> None:
    """The graph as JSON lines under ``<folder>/nodes`` and ``<folder>/edges``, written by all executors."""
    for name, parts in (("nodes", [_node_json(t) for t in catalog.nodes.values()]), ("edges", [_edge_json(t) for t in catalog.edges])):
        out = None
        for p in parts:
            out = p if out is None else out.unionAll(p)
        if out is not None:
            out.write.text(f"{folder}/{name}")


def read(catalog: Catalog, folder: str) -> Catalog:
    """A graph written by ``write``, or JSON lines of the same form, added by all executors.

    New ids are the old ones behind a prefix that is drawn once, so that edges need no join to find theirs.
    """
    spark, prefix = catalog.spark, uuid.uuid4().hex
    new = lambda c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    lines = spark.read.json(f"{folder}/nodes")
    if not lines.columns:  # no nodes at all
        lines = spark.createDataFrame([], "id string, labels array<string>")
    if "labels" not in lines.columns or "id" not in lines.columns:
        raise GraphError("nodes need an id and labels")
    names = _members(lines, "properties")
    # label sets are as few as a catalog's tables; each keeps the properties that its nodes have
    found = lines.groupBy(F.to_json("labels").alias("key")).agg(F.any_value("labels").alias("labels"), F.count("id").alias("ids"), F.count("*").alias("n"), *[F.count(F.col(f"properties.`{p}`")).alias(f"p{i}") for i, p in enumerate(names)], *([F.count("vector").alias("vectors")] if "vector" in lines.columns else [])).collect()
    for r in found:
        if r["ids"] < r["n"]:
            raise GraphError("a node has no id")
        cols = [new("id").alias("_id")] + ([F.col("vector").cast("array<float>").alias("_vec")] if "vectors" in r and r["vectors"] else [])
        cols += [F.col(f"properties.`{p}`").alias(p) for i, p in enumerate(names) if r[f"p{i}"]]
        own = lines.where(F.to_json("labels").eqNullSafe(F.lit(r["key"])))
        catalog = catalog.with_nodes(tuple(r["labels"] or ()), own.select(*cols))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/edges")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return catalog
    edges = spark.read.json(f"{folder}/edges")
    if not {"source", "target", "type"} <= set(edges.columns):
        return catalog
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    lost = ends.join(lines.select("id"), "id", "left_anti").take(1)
    if lost:
        raise GraphError(f"an edge has the end {lost[0][0]}, which is no node of the graph")
    names = _members(edges, "properties")
    edges = written(edges.withColumn("_eid", F.expr("uuid()")), "edges")
    for r in edges.groupBy("type").agg(*[F.count(F.col(f"properties.`{p}`")).alias(f"p{i}") for i, p in enumerate(names)], F.count("*").alias("n")).collect():
        cols = ["_eid", new("source").alias("_src"), new("target").alias("_dst"), *[F.col(f"properties.`{p}`").alias(p) for i, p in enumerate(names) if r[f"p{i}"]]]
        catalog = catalog.with_new_edges(r["type"], edges.where(F.col("type") == r["type"]).select(*cols))
    return catalog


def _members(df: DataFrame, name: str) -> list[str]:
    kind = df.schema[name].dataType if name in df.columns else None
    return kind.names if isinstance(kind, T.StructType) else []
