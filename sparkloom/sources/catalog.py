"""The property graph as DataFrames: a table for each set of labels, tables for each relationship type.

Tables are immutable; a change makes a new catalog that shares all other tables, so an old catalog is a snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

#: Changes after which a table is written down, so that its plan does not grow without end.
MOST_CHANGES = 8
NODE_COLUMNS = ("_id", "_vec")
EDGE_COLUMNS = ("_eid", "_src", "_dst")


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one set of labels: ``_id``, typed property columns and, if nodes have vectors, ``_vec``.

    ``key`` is a property that stands for the id (equal if and only if the ids are), so that joins can compare it.
    """

    labels: tuple[str, ...]
    df: DataFrame
    changes: int = 0
    key: str | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in NODE_COLUMNS}

    @property
    def has_vectors(self) -> bool:
        return "_vec" in self.df.columns


@dataclass(frozen=True)
class ForeignKey:
    """Edges that are a column of the nodes at one end: no table of their own, no join to reach the other end.

    ``owner`` ("src" or "dst") is the end whose nodes (of label ``label``) hold ``prop``; the other end's id is
    ``prefix`` followed by that property.
    """

    owner: str
    label: str
    prop: str
    prefix: str

    def other_id(self, prop: Callable[[str], Column]) -> Column:
        key = prop(self.prop)
        return F.when(key.isNotNull(), F.concat(F.lit(self.prefix), key.cast("string")))


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one type: ``_eid, _src, _dst`` and property columns; labels of the ends where they are known.

    ``src_key`` and ``dst_key`` are properties that hold the key property of the node at that end.
    """

    type: str
    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None
    key: ForeignKey | None = None
    changes: int = 0
    src_key: str | None = None
    dst_key: str | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in EDGE_COLUMNS}


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    nodes: dict[tuple[str, ...], NodeTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()
    version: int = 0
    #: Indexes built so far; snapshots share them, and each says which tables it is of.
    indexes: dict = field(default_factory=dict, compare=False)

    # ----------------------------------------------------------------- reading

    def node_tables(self, labels=()) -> list[NodeTable]:
        """Tables whose nodes have all of ``labels``."""
        return [t for t in self.nodes.values() if set(labels) <= set(t.labels)]

    def edge_tables(self, types=()) -> list[EdgeTable]:
        return [t for t in self.edges if not types or t.type in types]

    def labels(self) -> list[str]:
        return sorted({label for t in self.nodes.values() for label in t.labels})

    def types(self) -> list[str]:
        return sorted({t.type for t in self.edges})

    # ----------------------------------------------------------------- building and changing

    def with_nodes(self, labels: tuple[str, ...], df: DataFrame) -> Catalog:
        """Nodes added to the table of ``labels``."""
        old = self.nodes.get(tuple(labels))
        if old:
            df = merged([old.df, df])
        return self.with_table(NodeTable(tuple(labels), df, old.changes + 1 if old else 0))

    def with_table(self, table: NodeTable) -> Catalog:
        if table.changes >= MOST_CHANGES:
            table = replace(table, df=written(table.df, "nodes"), changes=0)
        return replace(self, nodes={**self.nodes, table.labels: table}, version=self.version + 1)

    def with_edges(self, *tables: EdgeTable) -> Catalog:
        """Edge tables added; a small one of new edges joins an equal one made before."""
        return replace(self, edges=(*self.edges, *tables), version=self.version + 1)

    def with_new_edges(self, type_: str, df: DataFrame) -> Catalog:
        """New edges, gathered in one plain table for each type."""
        edges = list(self.edges)
        for i, t in enumerate(edges):
            if t.type == type_ and t.key is None and t.src_label is None and t.dst_label is None:
                edges[i] = self._settled(replace(t, df=merged([t.df, df]), changes=t.changes + 1))
                break
        else:
            edges.append(EdgeTable(type_, df))
        return replace(self, edges=tuple(edges), version=self.version + 1)

    def with_edge_dfs(self, changed: dict[int, DataFrame]) -> Catalog:
        """Other contents for the edge tables at the given positions; they then stand on their own."""
        edges = [self._settled(replace(t, df=changed[i], key=None, changes=t.changes + 1)) if i in changed else t for i, t in enumerate(self.edges)]
        return replace(self, edges=tuple(edges), version=self.version + 1)

    def without_keys_on(self, labels: tuple[str, ...], prop: str | None = None) -> Catalog:
        """Edges that are columns of nodes with ``labels`` become tables, before those nodes (or ``prop``) change."""
        edges = [replace(t, key=None) if t.key and t.key.label in labels and prop in (None, t.key.prop) else t for t in self.edges]
        return replace(self, edges=tuple(edges))

    @staticmethod
    def _settled(t: EdgeTable) -> EdgeTable:
        return replace(t, df=written(t.df, "edges"), changes=0) if t.changes >= MOST_CHANGES else t


def key_edges(type_: str, nodes: DataFrame, key: ForeignKey, src_label: str, dst_label: str) -> EdgeTable:
    """The edge table of a foreign key over the owner's nodes."""
    other = key.other_id(lambda p: F.col(f"`{p}`"))
    src, dst = (F.col("_id"), other) if key.owner == "src" else (other, F.col("_id"))
    df = nodes.select(F.concat(F.lit(type_ + ":"), F.col("_id")).alias("_eid"), src.alias("_src"), dst.alias("_dst")).where("_src is not null and _dst is not null")
    return EdgeTable(type_, df, src_label, dst_label, key)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Whole numbers widen to bigint, with floats to double; types without a common one are read as strings."""
    if a == b:
        return a
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    number = (*whole, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    if isinstance(a, number) and isinstance(b, number):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    return T.StringType()


def merged(dfs: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, each at its common type."""
    if len(dfs) == 1:
        return dfs[0]
    types: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    out = None
    for df in dfs:
        have = {f.name: f.dataType for f in df.schema.fields}
        cols = [F.lit(None).cast(t).alias(n) if n not in have else F.col(f"`{n}`").cast(t).alias(n) if have[n] != t else F.col(f"`{n}`") for n, t in types.items()]
        df = df.select(*cols)
        out = df if out is None else out.unionAll(df)
    return out
