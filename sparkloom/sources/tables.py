"""Property graphs over relational tables: rows are nodes, foreign keys are edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, EdgeTable, ForeignKey, NodeTable, key_edges

#: Label: table and its key columns.
NODES = {
    "Region": ("region", ["r_regionkey"]),
    "Nation": ("nation", ["n_nationkey"]),
    "Customer": ("customer", ["c_custkey"]),
    "Supplier": ("supplier", ["s_suppkey"]),
    "Order": ("orders", ["o_orderkey"]),
    "Part": ("part", ["p_partkey"]),
    "Vec": ("embeddings", ["vec_id"]),
    "Turn": ("conversations", ["conv_id", "turn"]),
    "Doc": ("documents", ["doc_id"]),
}
#: Edges that a column of the nodes at one end holds: type, from, to, owner's end, property.
KEYS = [
    ("IN_REGION", "Nation", "Region", "src", "n_regionkey"),
    ("IN_NATION", "Customer", "Nation", "src", "c_nationkey"),
    ("IN_NATION", "Supplier", "Nation", "src", "s_nationkey"),
    ("PLACED", "Customer", "Order", "dst", "o_custkey"),
]
VECTOR_EDGES = ("CALLS", "IMPORTS", "REFERENCES")


def whole_numbers_as_long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) else F.col(f.name) for f in df.schema.fields])


def node_id(label: str, *keys: str):
    return F.concat_ws(":", F.lit(label), *[F.col(k).cast("string") for k in keys])


class TableGraph:
    """The graph of a folder of Parquet tables, built table by table as labels and types are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}
        self._nodes: dict[str, NodeTable] = {}
        self._edges: dict[str, list[EdgeTable]] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = whole_numbers_as_long(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        return self._read[name]

    def nodes(self, label: str) -> NodeTable:
        if label not in self._nodes:
            name, keys = NODES[label]
            df = self.table(name)
            if label == "Doc":
                df = df.join(self.table("labels"), "doc_id", "left")
            vector = [F.col("embedding").alias("_vec")] if label == "Vec" else []
            cols = [F.col(c) for c in df.columns if c != "embedding"]
            self._nodes[label] = NodeTable((label,), df.select(node_id(label, *keys).alias("_id"), *cols, *vector), key=keys[0] if len(keys) == 1 else None)
        return self._nodes[label]

    def edges(self, kind: str) -> list[EdgeTable]:
        if kind not in self._edges:
            self._edges[kind] = _BUILDERS[kind](self) if kind in _BUILDERS else [self._key_edges(*k) for k in KEYS if k[0] == kind]
        return self._edges[kind]

    def _key_edges(self, kind: str, src: str, dst: str, owner: str, prop: str) -> EdgeTable:
        label, other = (src, dst) if owner == "src" else (dst, src)
        return key_edges(kind, self.nodes(label).df, ForeignKey(owner, label, prop, f"{other}:"), src, dst)

    def catalog(self, labels=(), kinds=()) -> Catalog:
        """The graph of the given labels and edge types (all if none are given)."""
        labels = labels or NODES
        kinds = kinds or [*dict.fromkeys(k[0] for k in KEYS), *_BUILDERS]
        out = Catalog(self.spark, {(x,): self.nodes(x) for x in labels})
        return replace(out, edges=tuple(t for k in kinds for t in self.edges(k)))


def _contains(g: TableGraph) -> list[EdgeTable]:
    """Order lines: an order contains a part, with the line's columns."""
    lines = g.table("lineitem")
    # no set of key columns is unique in these tables: the whole line tells lines apart
    eid = F.concat_ws(":", F.lit("CONTAINS"), "l_orderkey", "l_partkey", "l_suppkey", F.hex(F.xxhash64(*lines.columns)))
    df = lines.select(eid.alias("_eid"), node_id("Order", "l_orderkey").alias("_src"), node_id("Part", "l_partkey").alias("_dst"), *lines.columns)
    return [EdgeTable("CONTAINS", df, "Order", "Part", src_key="l_orderkey", dst_key="l_partkey")]


def _supplies(g: TableGraph) -> list[EdgeTable]:
    pairs = g.table("lineitem").select("l_suppkey", "l_partkey").distinct()
    df = pairs.select(F.concat_ws(":", F.lit("SUPPLIES"), "l_suppkey", "l_partkey").alias("_eid"), node_id("Supplier", "l_suppkey").alias("_src"), node_id("Part", "l_partkey").alias("_dst"), *pairs.columns)
    return [EdgeTable("SUPPLIES", df, "Supplier", "Part", src_key="l_suppkey", dst_key="l_partkey")]


def _next(g: TableGraph) -> list[EdgeTable]:
    turns = g.table("conversations").select("conv_id", "turn")
    after = turns.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"))
    pairs = turns.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left_semi")
    eid = F.concat_ws(":", F.lit("NEXT"), "conv_id", "turn")
    df = pairs.select(eid.alias("_eid"), node_id("Turn", "conv_id", "turn").alias("_src"), F.concat_ws(":", F.lit("Turn"), "conv_id", F.col("turn") + 1).alias("_dst"))
    return [EdgeTable("NEXT", df, "Turn", "Turn")]


def _vector_edges(kind: str) -> Callable[[TableGraph], list[EdgeTable]]:
    """Of N vectors: 2N edges, the i-th from i mod N to (7i + 3) mod N, their types in turn."""

    def build(g: TableGraph) -> list[EdgeTable]:
        n = g.table("embeddings").count()
        if not n:
            return [EdgeTable(kind, g.spark.createDataFrame([], "_eid string, _src string, _dst string"), "Vec", "Vec")]
        i = F.col("id")
        df = g.spark.range(2 * n).where(i % 3 == VECTOR_EDGES.index(kind))
        df = df.select(F.concat_ws(":", F.lit(kind), i).alias("_eid"), F.concat_ws(":", F.lit("Vec"), i % n).alias("_src"), F.concat_ws(":", F.lit("Vec"), (i * 7 + 3) % n).alias("_dst"))
        return [EdgeTable(kind, df, "Vec", "Vec")]

    return build


_BUILDERS: dict[str, Callable[[TableGraph], list[EdgeTable]]] = {"CONTAINS": _contains, "SUPPLIES": _supplies, "NEXT": _next} | {k: _vector_edges(k) for k in VECTOR_EDGES}
