"""CREATE, MERGE, SET, REMOVE and DELETE as copy-on-write changes of a catalog.

The rows that a change works on are written down first: new ids are drawn once, and a change never reads what it
changes.  Each function returns the new catalog and the rows, whose bindings keep the values they had.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CypherTypeError, NodeHasEdges
from ..functions import values as V
from ..functions.expressions import Compiler
from ..plans import ast as A
from ..sources.catalog import Catalog, NodeTable, merged
from ..sources.scratch import has_rows, written
from .match import Matcher
from .rows import Edge, Node, Rows, col, new_slot


def _frozen(rows: Rows, name: str) -> Rows:
    """The rows written down (a single empty row stays as it is)."""
    return rows if rows.df is None or not rows.df.columns else rows.with_df(written(rows.df, name))


def _property_columns(props: tuple, compiler: Compiler, slot: str) -> dict[str, Any]:
    """Columns ``<slot>_<key>`` for the inline properties; a null has no column."""
    cols = {}
    for key, e in props:
        v = compiler.stored(e)
        if v.type != "null":
            cols[f"{slot}_{key}"] = v.col
    return cols


def create(catalog: Catalog, rows: Rows, paths: tuple, params: dict[str, Any]) -> tuple[Catalog, Rows]:
    single = rows.df is None
    df = catalog.spark.range(1).select(F.lit(True).alias(new_slot("u"))) if single else rows.df
    scope = dict(rows.scope)
    made_nodes: list[tuple[Node, tuple[str, ...]]] = []
    made_edges: list[tuple[Edge, str]] = []
    for path in paths:
        ends = []
        for n in path.nodes:
            if n.var and n.var in scope:
                if n.labels or n.props:
                    raise CypherTypeError(f"`{n.var}` is bound already")
                ends.append(scope[n.var])
                continue
            slot = new_slot("n")
            cols = _property_columns(n.props, Compiler(scope, params), slot)
            new_id = F.lit(str(uuid.uuid4())) if single else F.uuid()
            df = df.withColumns({f"{slot}__id": new_id, f"{slot}__labels": F.array(*[F.lit(x) for x in n.labels]).cast("array<string>"), **cols})
            kinds = {f.name: f.dataType for f in df.schema.fields}
            node = Node(slot, {c.removeprefix(f"{slot}_"): kinds[c] for c in cols}, (n.labels,))
            made_nodes.append((node, n.labels))
            scope[n.var or new_slot("?")] = node
            ends.append(node)
        for i, e in enumerate(path.edges):
            if e.hops:
                raise CypherTypeError("a variable-length relationship cannot be created")
            a, b = (ends[i + 1], ends[i]) if e.direction == "in" else (ends[i], ends[i + 1])
            slot = new_slot("e")
            kind = e.types[0] if e.types else ""
            cols = _property_columns(e.props, Compiler(scope, params), slot)
            df = df.withColumns({f"{slot}__eid": F.lit(str(uuid.uuid4())) if single else F.uuid(), f"{slot}__src": a.id, f"{slot}__dst": b.id, f"{slot}__type": F.lit(kind), **cols})
            kinds = {f.name: f.dataType for f in df.schema.fields}
            edge = Edge(slot, {c.removeprefix(f"{slot}_"): kinds[c] for c in cols}, (kind,))
            made_edges.append((edge, kind))
            if e.var:
                scope[e.var] = edge
    if not single:
        df = written(df, "create")
    for node, labels in made_nodes:
        catalog = catalog.with_nodes(labels, df.select(node.id.alias("_id"), *[col(f"{node.slot}_{p}").alias(p) for p in node.props]))
    for edge, kind in made_edges:
        ends = df.select(edge.id.alias("_eid"), col(f"{edge.slot}__src").alias("_src"), col(f"{edge.slot}__dst").alias("_dst"), *[col(f"{edge.slot}_{p}").alias(p) for p in edge.props])
        catalog = catalog.with_new_edges(kind, ends.where("_src is not null and _dst is not null"))
    return catalog, Rows(df, {k: v for k, v in scope.items() if not k.startswith("?")})


def _change(catalog: Catalog, node: Node, changes: DataFrame, key: str, kind: Any) -> Catalog:
    """Sets ``key`` of the nodes in ``changes`` (id, value) to the value."""
    changes = changes.where("id is not null").groupBy("id").agg(F.any_value("value").alias("value"))
    for labels in node.tables:
        table = catalog.nodes[labels]
        catalog = catalog.without_keys_on(labels, key)
        old = table.df if key in table.props else table.df.withColumn(key, F.lit(None).cast(kind))
        have = old.schema[key].dataType
        target = merged([old.select(key).limit(0), changes.select(F.col("value").alias(key)).limit(0)]).schema[key].dataType
        both = old.join(changes.select(F.col("id").alias("__hit"), F.col("value").alias("__new")), F.col("_id") == F.col("__hit"), "left")
        new = F.when(F.col("__hit").isNotNull(), F.col("__new").cast(target)).otherwise(F.col(f"`{key}`").cast(target)) if have != target else F.when(F.col("__hit").isNotNull(), F.col("__new").cast(target)).otherwise(F.col(f"`{key}`"))
        df = both.withColumn(key, new).drop("__hit", "__new")
        catalog = catalog.with_table(NodeTable(labels, df, table.changes + 1))
    return catalog


def set_properties(catalog: Catalog, rows: Rows, items: tuple, params: dict[str, Any]) -> tuple[Catalog, Rows]:
    rows = _frozen(rows, "set")
    compiler = Compiler(rows.scope, params)
    for var, key, e in items:
        node = rows.scope.get(var)
        if node is None:
            raise CypherTypeError(f"variable `{var}` is not defined")
        if not isinstance(node, Node):
            continue  # properties of relationships and values are not set
        v = compiler.stored(e)
        changes = rows.df.select(node.id.alias("id"), (F.lit(None).cast("string") if v.type == "null" else v.col).alias("value"))
        catalog = _change(catalog, node, changes, key, changes.schema["value"].dataType)
    return catalog, rows


def remove_properties(catalog: Catalog, rows: Rows, items: tuple) -> tuple[Catalog, Rows]:
    rows = _frozen(rows, "remove")
    for var, key in items:
        node = rows.scope.get(var)
        if node is None:
            raise CypherTypeError(f"variable `{var}` is not defined")
        if not isinstance(node, Node):
            continue
        for labels in node.tables:
            table = catalog.nodes[labels]
            if key in table.props:
                kind = table.props[key]
                only = replace(node, tables=(labels,))
                catalog = _change(catalog, only, rows.df.select(node.id.alias("id"), F.lit(None).cast(kind).alias("value")), key, kind)
    return catalog, rows


def delete(catalog: Catalog, rows: Rows, targets: tuple, detach: bool) -> tuple[Catalog, Rows]:
    if rows.df is None:
        raise CypherTypeError("DELETE needs rows")
    rows = _frozen(rows, "delete")
    for e in targets:
        bound = rows.scope.get(e.name) if isinstance(e, A.Variable) else None
        if not isinstance(bound, (Node, Edge)):
            raise CypherTypeError("only nodes and relationships can be deleted")
        ids = rows.df.select(bound.id.alias("__gone"))
        if has_rows(ids.where("__gone is null")):
            raise CypherTypeError(f"`{e.name}` is null and cannot be deleted")
        ids = ids.distinct()
        catalog = delete_edges(catalog, ids, bound.types) if isinstance(bound, Edge) else delete_nodes(catalog, ids, bound.tables, detach)
    return catalog, rows


def delete_edges(catalog: Catalog, ids: DataFrame, types: tuple[str, ...] = ()) -> Catalog:
    """Without the edges of ``ids`` (__gone)."""
    return catalog.with_edge_dfs({i: t.df.join(ids, F.col("_eid") == F.col("__gone"), "left_anti") for i, t in enumerate(catalog.edges) if not types or t.type in types})


def delete_nodes(catalog: Catalog, ids: DataFrame, tables: tuple[tuple[str, ...], ...], detach: bool) -> Catalog:
    """Without the nodes of ``ids`` (__gone), which are in ``tables``; their edges go with ``detach``, else are an error."""
    names = {label for t in tables for label in t}
    touching = {i: t for i, t in enumerate(catalog.edges) if any(label is None or label in names for label in (t.src_label, t.dst_label))}
    rest = {}
    for i, t in touching.items():
        df = t.df
        for end, label in (("_src", t.src_label), ("_dst", t.dst_label)):
            if label is None or label in names:
                if not detach and has_rows(df.join(ids, F.col(end) == F.col("__gone"), "left_semi")):
                    raise NodeHasEdges("a node to be deleted still has edges; use DETACH DELETE")
                df = df.join(ids, F.col(end) == F.col("__gone"), "left_anti")
        rest[i] = df
    if detach:
        catalog = catalog.with_edge_dfs(rest)
    for labels in tables:
        catalog = catalog.without_keys_on(labels)
        table = catalog.nodes[labels]
        catalog = catalog.with_table(replace(table, df=table.df.join(ids, F.col("_id") == F.col("__gone"), "left_anti"), changes=table.changes + 1))
    return catalog


def merge(catalog: Catalog, rows: Rows, clause: A.Merge, params: dict[str, Any]) -> tuple[Catalog, Rows]:
    """Rows with equal keys make one node; the second of them, like any row that finds nodes, counts as a match."""
    n = clause.node
    if n.var and n.var in rows.scope:
        raise CypherTypeError(f"`{n.var}` is bound already")
    compiler = Compiler(rows.scope, params)
    wants = {key: compiler.stored(e) for key, e in n.props}
    source = rows.start(catalog.spark)
    keys = {key: new_slot("m") for key in wants}
    row_id = new_slot("r")
    source = source.withColumns({keys[k]: F.lit(None).cast("string") if v.type == "null" else v.col for k, v in wants.items()} | {row_id: F.uuid()})
    source = written(source, "merge")
    matcher = Matcher(catalog, params, {n.var} if n.var else set())
    df, node = matcher.scan(n.var, n.labels, ())
    on = F.lit(True)
    for k, v in wants.items():
        on = on & V.equal(node.property(k), V.Value(col(keys[k]), v.type), plain=False) & col(keys[k]).isNotNull()
    hits = source.join(df.select(*[col(c) for c in node.columns]), on)
    matched = written(hits.select(row_id, node.id.alias("id")), "matched")
    missing = source.join(matched.select(F.col(row_id).alias("__r")), col(row_id) == F.col("__r"), "left_anti")
    names = list(keys.values())
    fresh = missing.groupBy(*names).agg(F.count("*").alias("__n")) if names else missing.agg(F.count("*").alias("__n")).where("__n > 0")
    fresh = written(fresh.withColumn("__id", F.uuid()), "merged")
    new = fresh.select(F.col("__id").alias("_id"), *[col(keys[k]).alias(k) for k, v in wants.items() if v.type != "null"])
    created = missing.join(fresh.select(*[col(c).alias(f"{c}~") for c in names], "__id", "__n"), _null_safe(names))
    pairs = written(matched.select(row_id, "id", F.lit(False).alias("made"), F.lit(False).alias("again")).unionAll(created.select(row_id, "__id", F.lit(True), F.col("__n") > 1)), "merge_pairs")
    if has_rows(new):
        catalog = catalog.with_nodes(n.labels, new)
    # bind the rows to the nodes as they are after creation
    matcher = Matcher(catalog, params, {n.var} if n.var else set())
    df, node = matcher.scan(n.var, n.labels, ())
    bound = source.join(pairs.withColumnsRenamed({row_id: "__r", "id": "__node"}), col(row_id) == F.col("__r")).join(df, F.col("__node") == node.id)
    scope = {**rows.scope, n.var or "?": node}
    for items, which in ((clause.on_create, F.col("made")), (clause.on_match, ~F.col("made") | F.col("again"))):
        if items:
            catalog, _ = set_properties(catalog, Rows(bound.where(which), scope), items, params)
    # bindings show what the actions have set
    df, node = Matcher(catalog, params, set()).scan(n.var, n.labels, ())
    keep = [c for b in rows.scope.values() for c in b.columns]
    out = source.join(pairs.withColumnsRenamed({row_id: "__r", "id": "__node"}), col(row_id) == F.col("__r")).join(df, F.col("__node") == node.id)
    out = out.select(*[col(c) for c in (*keep, *node.columns)])
    return catalog, Rows(out, {**rows.scope, **({n.var: node} if n.var else {})})


def _null_safe(names: list[str]):
    out = F.lit(True)
    for c in names:
        out = out & col(c).eqNullSafe(col(f"{c}~"))
    return out


__all__ = ["create", "delete", "delete_edges", "delete_nodes", "merge", "remove_properties", "set_properties"]
