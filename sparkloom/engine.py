"""The graph engine: queries in the query language, and the same operations as methods."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EdgeNotFound, GraphError, NodeNotFound
from .functions import vectors
from .operators import write
from .operators.rows import new_slot
from .plans.execute import execute
from .plans.parser import parse
from .sources import graph_json
from .sources.catalog import MOST_CHANGES, Catalog, NodeTable, merged
from .sources.scratch import has_rows, written


class GraphEngine:
    """A property graph.  Changes replace ``catalog``; ``begin`` and ``rollback`` go back to an earlier one."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark)
        self.raw_vectors: DataFrame | None = None
        self._raw_changes = 0
        self._saved: list[Catalog] = []
        self.indexes: set[tuple[str, str]] = set()

    # ----------------------------------------------------------------- queries

    def cypher(self, query: str, params: dict[str, Any] | str | None = None) -> DataFrame:
        """Runs the statements of ``query``; the last result, or an empty DataFrame if there is none."""
        result = self._run(query, params)
        return self.spark.createDataFrame([], T.StructType([])) if result is None else result

    def cypher_with_params(self, query: str, params: dict[str, Any] | str) -> DataFrame:
        return self.cypher(query, params)

    def cypher_batch(self, queries: Iterable[str], params: dict[str, Any] | str | None = None) -> DataFrame:
        """Runs queries in order with the same parameters; the last result that has columns."""
        last = None
        for q in queries:
            result = self._run(q, params)
            last = result if result is not None else last
        return self.spark.createDataFrame([], T.StructType([])) if last is None else last

    def _run(self, query: str, params: dict[str, Any] | str | None) -> DataFrame | None:
        if isinstance(params, str):
            params = json.loads(params)
        if params is not None and not isinstance(params, dict):
            raise GraphError("parameters must be an object")
        last = None
        for statement in parse(query):
            catalog, result = execute(statement, self.catalog, params or {})
            self.catalog = catalog
            last = result if result is not None else last
        return last

    # ----------------------------------------------------------------- snapshots

    def begin(self) -> None:
        self._saved.append(self.catalog)

    def commit(self) -> None:
        self._saved.pop()

    def rollback(self) -> None:
        self.catalog = self._saved.pop()

    # ----------------------------------------------------------------- nodes

    def _node_row(self, labels: Iterable[str], props: dict[str, Any], vector: Iterable[float] | None, node_id: str) -> DataFrame:
        return graph_json.node_frame(self.spark, [{"id": node_id, "labels": list(labels), "properties": props, "vector": None if vector is None else list(vector)}])

    def create_node(self, labels: Iterable[str], props: dict[str, Any] | None = None) -> str:
        return self.create_nodes_batch([(list(labels), props or {})])[0]

    def create_node_with_vector(self, labels: Iterable[str], props: dict[str, Any] | None, vector: Iterable[float]) -> str:
        node_id, labels = str(uuid.uuid4()), tuple(labels)
        self.catalog = self.catalog.with_nodes(labels, self._node_row(labels, props or {}, vector, node_id))
        return node_id

    def create_nodes_batch(self, nodes: Iterable[tuple[list[str], dict[str, Any]]]) -> list[str]:
        """New nodes of (labels, properties), a table at a time; their ids in order."""
        ids, by_labels = [], {}
        for labels, props in nodes:
            ids.append(str(uuid.uuid4()))
            by_labels.setdefault(tuple(labels), []).append({"id": ids[-1], "labels": labels, "properties": props, "vector": None})
        for labels, rows in by_labels.items():
            self.catalog = self.catalog.with_nodes(labels, graph_json.node_frame(self.spark, rows))
        return ids

    def create_nodes_from(self, labels: Iterable[str], rows: DataFrame, id_col: str | None = None, vector_col: str | None = None) -> None:
        """New nodes, one for each row of a DataFrame of any size: its columns are their properties.

        Ids are those of ``id_col`` (as strings; they must be new) or drawn.  Drawn ids are written down once.
        """
        fixed = [F.expr("uuid()").alias("_id") if id_col is None else F.col(f"`{id_col}`").cast("string").alias("_id")]
        if vector_col is not None:
            fixed.append(F.col(f"`{vector_col}`").cast("array<float>").alias("_vec"))
        rows = rows.select(*fixed, *[F.col(f"`{c}`") for c in rows.columns if c not in (id_col, vector_col)])
        self.catalog = self.catalog.with_nodes(tuple(labels), written(rows, "nodes") if id_col is None else rows)

    def create_edges_from(self, rel_type: str, rows: DataFrame, source_col: str, target_col: str) -> None:
        """New edges, one for each row of a DataFrame of any size; endpoints are not looked up."""
        ends = [F.expr("uuid()").alias("_eid"), F.col(f"`{source_col}`").cast("string").alias("_src"), F.col(f"`{target_col}`").cast("string").alias("_dst")]
        rows = rows.select(*ends, *[F.col(f"`{c}`") for c in rows.columns if c not in (source_col, target_col)])
        self.catalog = self.catalog.with_new_edges(rel_type, written(rows, "edges"))

    def _table_of(self, node_id: str) -> NodeTable:
        for t in self.catalog.nodes.values():
            if has_rows(t.df.where(F.col("_id") == node_id)):
                return t
        raise NodeNotFound(node_id)

    def get_node(self, node_id: str) -> DataFrame:
        """``id, labels, properties`` (JSON) of a node: no row if there is none."""
        return self._described(self.catalog.node_tables()).where(F.col("id") == node_id)

    def _described(self, tables: list[NodeTable]) -> DataFrame:
        dfs = [t.df.select(F.col("_id").alias("id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("labels"), graph_json.properties_json(t.props).alias("properties")) for t in tables]
        return merged(dfs) if dfs else self.spark.createDataFrame([], "id string, labels array<string>, properties string")

    def nodes_by_label(self, label: str) -> DataFrame:
        return self._described(self.catalog.node_tables((label,)))

    def all_nodes(self) -> DataFrame:
        return self._described(self.catalog.node_tables())

    def get_node_vector(self, node_id: str) -> list[float] | None:
        for t in self.catalog.nodes.values():
            if t.has_vectors and (row := t.df.where(F.col("_id") == node_id).select("_vec").take(1)):
                return row[0][0]
        return None

    def set_node_vector(self, node_id: str, vector: Iterable[float]) -> None:
        t = self._table_of(node_id)
        new = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
        old = F.col("_vec").cast("array<float>") if t.has_vectors else F.lit(None).cast("array<float>")
        df = t.df.withColumn("_vec", F.when(F.col("_id") == node_id, new).otherwise(old))
        self.catalog = self.catalog.with_table(replace(t, df=df, changes=t.changes + 1))

    def all_node_vectors(self) -> DataFrame:
        dfs = [t.df.select(F.col("_id").alias("id"), F.col("_vec").cast("array<float>").alias("vector")).where("vector is not null") for t in self.catalog.nodes.values() if t.has_vectors]
        return merged(dfs) if dfs else self.spark.createDataFrame([], "id string, vector array<float>")

    def set_node_property(self, node_id: str, key: str, value: Any) -> None:
        t = self._table_of(node_id)
        self.catalog = self.catalog.without_keys_on(t.labels, key)
        new = graph_json.literal(value)
        df = t.df if key in t.props else t.df.withColumn(key, F.lit(None).cast("string" if value is None else t.df.select(new.alias("x")).schema["x"].dataType))
        kind = merged([df.select(key).limit(0), df.select(new.alias(key)).limit(0)]).schema[key].dataType
        df = df.withColumn(key, F.when(F.col("_id") == node_id, new.cast(kind)).otherwise(F.col(f"`{key}`").cast(kind)))
        self.catalog = self.catalog.with_table(replace(t, df=df, changes=t.changes + 1))

    def delete_node(self, node_id: str, detach: bool = False) -> None:
        t = self._table_of(node_id)
        ids = self.spark.createDataFrame([(node_id,)], "__gone string")
        self.catalog = write.delete_nodes(self.catalog, ids, (t.labels,), detach)

    # ----------------------------------------------------------------- edges

    def create_edge(self, source: str, target: str, rel_type: str, props: dict[str, Any] | None = None) -> str:
        for end in (source, target):
            self._table_of(end)
        return self.create_edges_batch([(source, target, rel_type, props or {})])[0]

    def create_edges_batch(self, edges: Iterable[tuple[str, str, str, dict[str, Any]]]) -> list[str]:
        """New edges of (source, target, type, properties); endpoints are not looked up."""
        ids, by_type = [], {}
        for source, target, kind, props in edges:
            ids.append(str(uuid.uuid4()))
            by_type.setdefault(kind, []).append({"id": ids[-1], "source": source, "target": target, "properties": props})
        for kind, rows in by_type.items():
            self.catalog = self.catalog.with_new_edges(kind, graph_json.edge_frame(self.spark, rows))
        return ids

    def _edges_described(self) -> DataFrame:
        dfs = [t.df.select(F.col("_eid").alias("id"), F.col("_src").alias("source"), F.col("_dst").alias("target"), F.lit(t.type).alias("type"), graph_json.properties_json(t.props).alias("properties")) for t in self.catalog.edges]
        return merged(dfs) if dfs else self.spark.createDataFrame([], "id string, source string, target string, type string, properties string")

    def get_edge(self, edge_id: str) -> DataFrame:
        return self._edges_described().where(F.col("id") == edge_id)

    def all_edges(self) -> DataFrame:
        return self._edges_described()

    def delete_edge(self, edge_id: str) -> None:
        if not has_rows(self.get_edge(edge_id)):
            raise EdgeNotFound(edge_id)
        self.catalog = write.delete_edges(self.catalog, self.spark.createDataFrame([(edge_id,)], "__gone string"))

    def neighbors(self, node_id: str, rel_type: str | None = None) -> DataFrame:
        """Nodes that the node's outgoing edges lead to, a row for each edge."""
        edges = self._edges_described().where(F.col("source") == node_id)
        if rel_type is not None:
            edges = edges.where(F.col("type") == rel_type)
        return edges.select(F.col("target").alias("__t")).join(self.all_nodes(), F.col("__t") == F.col("id")).drop("__t")

    # ----------------------------------------------------------------- catalog

    def create_property_index(self, label: str, prop: str) -> None:
        """Writes the label's tables clustered by ``prop``, so that lookups skip files and row groups; the order is lost when they change."""
        for t in self.catalog.node_tables((label,)):
            if prop in t.props:
                clustered = t.df.repartitionByRange(F.col(f"`{prop}`"), F.col("_id")).sortWithinPartitions(F.col(f"`{prop}`"))
                self.catalog = self.catalog.with_table(replace(t, df=written(clustered, "clustered"), changes=0))
        self.indexes.add((label, prop))

    def reindex(self) -> list[tuple[str, str]]:
        """An index for every property of every label."""
        found = sorted({(label, p) for t in self.catalog.nodes.values() for label in t.labels for p in t.props})
        for label, prop in found:
            self.indexes.add((label, prop))
        return found

    def labels(self) -> list[str]:
        return self.catalog.labels()

    def relationship_types(self) -> list[str]:
        return self.catalog.types()

    def edge_count(self) -> int:
        return sum(t.df.count() for t in self.catalog.edges)

    def has_vectors(self) -> bool:
        return any(t.has_vectors and has_rows(t.df.where("_vec is not null")) for t in self.catalog.nodes.values())

    def graph_stats(self) -> dict[str, Any]:
        return {"node_count": sum(t.df.count() for t in self.catalog.nodes.values()), "edge_count": self.edge_count(), "labels": self.labels(), "relationship_types": self.relationship_types(), "has_vectors": self.has_vectors()}

    def label_counts(self) -> DataFrame:
        """``l, c``: how many nodes have each label."""
        dfs = [t.df.select(F.explode(F.array(*[F.lit(x) for x in t.labels])).alias("l")) for t in self.catalog.nodes.values() if t.labels]
        return merged(dfs).groupBy("l").agg(F.count("*").alias("c")) if dfs else self.spark.createDataFrame([], "l string, c long")

    def type_counts(self) -> DataFrame:
        """``t, c``: how many edges there are of each type."""
        dfs = [t.df.select(F.lit(t.type).alias("t")) for t in self.catalog.edges]
        return merged(dfs).groupBy("t").agg(F.count("*").alias("c")) if dfs else self.spark.createDataFrame([], "t string, c long")

    # ----------------------------------------------------------------- interchange

    def export_json(self) -> dict[str, Any]:
        return graph_json.export(self.catalog)

    def import_json(self, graph: dict[str, Any] | str) -> tuple[int, int]:
        """Adds a graph (an object, JSON text or the path of a JSON file) under new ids; numbers of nodes and edges."""
        self.catalog, n, e = graph_json.load(self.catalog, graph)
        return n, e

    def export_json_lines(self, folder: str) -> None:
        """The graph as JSON lines under ``<folder>/nodes`` and ``<folder>/edges``, written by all executors."""
        graph_json.write(self.catalog, folder)

    def import_json_lines(self, folder: str) -> None:
        """Adds a graph of JSON lines, of any size, under new ids; an edge with an unknown end is an error."""
        self.catalog = graph_json.read(self.catalog, folder)

    # ----------------------------------------------------------------- vectors beside the graph

    def insert_vector(self, vector_id: str, vector: Iterable[float], metadata: dict[str, Any] | None = None) -> None:
        row = self.spark.createDataFrame([(vector_id, [float(x) for x in vector], json.dumps(metadata or {}))], "id string, vector array<float>, metadata string")
        self.insert_vectors(row)

    def insert_vectors(self, rows: DataFrame) -> None:
        """Rows of (id, vector, metadata as JSON), ids different; of equal ids the new one stays.  Written down after every few changes."""
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata"))
        if self.raw_vectors is not None:
            rows = self.raw_vectors.join(rows.select("id"), "id", "left_anti").unionByName(rows)
        self._raw_changes += 1
        if self._raw_changes >= MOST_CHANGES:
            rows, self._raw_changes = written(rows, "vectors"), 0
        self.raw_vectors = rows

    def get_vector(self, vector_id: str) -> list[float] | None:
        rows = [] if self.raw_vectors is None else self.raw_vectors.where(F.col("id") == vector_id).take(1)
        return rows[0]["vector"] if rows else None

    def query_vectors(self, query: Iterable[float], k: int) -> DataFrame:
        """``id, score, metadata`` of the k nearest by cosine; vectors of other lengths are passed over."""
        if self.raw_vectors is None:
            return self.spark.createDataFrame([], "id string, score double, metadata string")
        slot = new_slot("s")
        scored = self.raw_vectors.withColumn(slot, vectors.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])))
        return scored.where(F.col(slot).isNotNull()).orderBy(F.col(slot).desc(), "id").limit(k).select("id", F.col(slot).alias("score"), "metadata")
