"""Graph patterns as joins.

A pattern starts at its most selective node (bound, then with inline properties or, in variable-length patterns, with
conditions of the following WHERE, then the first) and grows hop by hop.  A hop is an equi-join of the rows with the edge tables of the wanted types and, if the far node's properties or
labels are needed, with its node tables.  Edges that are a foreign key of the nodes at one end cost no join of their
own: from the owner's side the far id is computed, towards the owner's side its nodes are joined on the key.
Edge tables that cannot connect the labels in question are left out when the plan is built.

Where only aggregates over the matches follow, rows that differ in nothing that is still read are gathered into one with
their number (``Rows.weight``) before a product or a hop that multiplies them: two branches that meet in few nodes cost
their sum, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError
from ..functions import values as V
from ..functions.expressions import Compiler
from ..plans import ast as A
from ..plans.usage import Uses
from ..sources.catalog import Catalog, EdgeTable, NodeTable, merged
from ..sources.scratch import has_rows, written
from .rows import Edge, Node, Rows, Scalar, col, new_slot

#: Levels of a variable-length pattern that are joined in one plan; deeper ones are written down level by level.
MOST_UNROLLED = 3
_FLIP = {"out": "in", "in": "out", "both": "both"}


@dataclass
class Matcher:
    catalog: Catalog
    params: dict[str, Any]
    full: set[str]  # variables of which more than the id is needed
    endpoints_only: bool = False
    #: Conditions on one node each, by its variable: variable-length patterns apply them before they grow.
    where: dict[str, list] = field(default_factory=dict)
    #: What is read after this pattern, if beyond that only the number of matches counts.
    uses: Uses | None = None

    # ----------------------------------------------------------------- scans

    def scan(self, var: str | None, labels: tuple[str, ...], props: tuple, tables: list[NodeTable] | None = None, extra=None) -> tuple[DataFrame, Node]:
        """All nodes with the labels; ``extra`` adds a column to a table's nodes: (name, function of a property getter)."""
        tables = self.catalog.node_tables(labels) if tables is None else tables
        slot = new_slot("n")
        dfs = []
        for t in tables:
            cols = [F.col("_id").alias(f"{slot}__id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias(f"{slot}__labels")]
            cols += [F.col(f"`{p}`").alias(f"{slot}_{p}") for p in t.props]
            if t.has_vectors:
                cols.append(F.col("_vec").alias(f"{slot}__vec"))
            if extra:
                cols.append(extra[1](lambda p: F.col(f"`{p}`")).alias(extra[0]))
            dfs.append(t.df.select(*cols))
        if not dfs:
            empty = self.catalog.spark.createDataFrame([], f"{slot}__id string, {slot}__labels array<string>")
            if extra:
                empty = empty.withColumn(extra[0], F.lit(None).cast("string"))
            return empty, Node(slot, {}, ())
        df = merged(dfs)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        names = list(dict.fromkeys(p for t in tables for p in t.props))
        key = tables[0].key if len(tables) == 1 else None
        node = Node(slot, {p: kinds[f"{slot}_{p}"] for p in names}, tuple(t.labels for t in tables), any(t.has_vectors for t in tables), key)
        return df, node

    def keep(self, df: DataFrame, entity: Any, props: tuple, scope: dict[str, Any]) -> DataFrame:
        """Rows whose entity has the inline properties: plain conditions, so that scans can push them down."""
        compiler = Compiler(scope, self.params)
        for name, e in props:
            want = compiler(e)
            df = df.where(V.equal(entity.property(name), want, plain=True))
        return df

    @staticmethod
    def labelled(df: DataFrame, node: Node, labels: tuple[str, ...]) -> DataFrame:
        """Rows whose bound node has all labels: nothing to test if all or none of its tables do."""
        if all(set(labels) <= set(t) for t in node.tables):
            return df.where(node.id.isNotNull()) if labels else df
        if not any(set(labels) <= set(t) for t in node.tables):
            return df.where(F.lit(False))
        for label in labels:
            df = df.where(F.array_contains(node.labels, label))
        return df

    # ----------------------------------------------------------------- patterns

    def match(self, rows: Rows, paths: tuple) -> Rows:
        rows = replace(rows, held=rows.held if rows.weight else tuple(dict.fromkeys((*rows.held, *rows.scope))))
        for i, path in enumerate(paths):
            rows = self.path(rows, path, {n.var for p in paths[i + 1 :] for n in p.nodes if n.var})
        return replace(rows, sortable={}, order=(), output=None)

    def path(self, rows: Rows, path: A.Path, later: set[str] = frozenset()) -> Rows:
        """``later`` are nodes of paths that follow."""
        # anonymous parts get names of their own
        nodes = [replace(n, var=n.var or new_slot("?")) for n in path.nodes]
        where = self.where if any(e.hops for e in path.edges) else {}
        start = min(range(len(nodes)), key=lambda i: (nodes[i].var not in rows.scope, not nodes[i].props and nodes[i].var not in where, i))
        names = [n.var for n in nodes]
        rows = self.filtered(self.node(rows, nodes[start], later | (set(names) if path.edges else set())), where.get(nodes[start].var, ()))
        for i in range(start, len(path.edges)):
            rows = self.hop(rows, nodes[i], path.edges[i], nodes[i + 1], path.edges[i].direction, later | {*names[i:], *(names[: start + 1] if start else ())})
            rows = self.filtered(rows, where.get(nodes[i + 1].var, ()))
        for i in range(start - 1, -1, -1):
            rows = self.hop(rows, nodes[i + 1], path.edges[i], nodes[i], _FLIP[path.edges[i].direction], later | set(names[: i + 2]))
            rows = self.filtered(rows, where.get(nodes[i].var, ()))
        return replace(rows, scope={k: v for k, v in rows.scope.items() if not k.startswith("?")})

    def filtered(self, rows: Rows, conditions) -> Rows:
        df = rows.df
        for condition in conditions:
            for c in Compiler(rows.scope, self.params).condition(condition):
                df = df.where(c)
        return rows.with_df(df) if conditions else rows

    def gathered(self, rows: Rows, nodes: set[str], near: str | None = None) -> Rows:
        """Rows that differ in nothing that is read later become one with their number, if that spares the next step work.

        ``nodes`` are those that patterns come back to.  It does if rows are told apart by nodes that the ``near`` one
        of the next hop does not fix, and all nodes that must be kept as such are fixed by it.
        """
        if self.uses is None or rows.df is None or rows.virtual or rows.known:
            return rows
        kept = {v for v in rows.scope if v in nodes or v in self.uses.later or v in self.uses.whole}
        fixed = {near} if near else set()
        while more := {b for a, b in rows.fixed if a in fixed} - fixed:
            fixed |= more
        values = {v for v in kept if isinstance(rows.scope[v], Scalar)}
        if not kept - values <= fixed or set(rows.held) <= fixed | values:
            return rows
        keys, carried, scope = {}, {}, {}
        for name, b in rows.scope.items():
            if isinstance(b, Scalar):
                if name in kept:
                    keys[b.name], scope[name] = None, b
                continue
            read = {f"{b.slot}_{p}" for p in self.uses.props.get(name, ())}
            if name not in kept:  # only its properties are read
                props = {p: kind for p, kind in (b.props or {}).items() if f"{b.slot}_{p}" in read}
                scope[name] = replace(b, props=props, has_vector=False, key=None) if isinstance(b, Node) else replace(b, props=props)
                keys |= dict.fromkeys(f"{b.slot}_{p}" for p in props)
                continue
            if name not in self.uses.whole:
                read |= {b.identity, f"{b.slot}__labels"} | {f"{b.slot}_{t.key.prop}" for t in self.catalog.edges if t.key}
            scope[name] = b
            for c in b.columns:
                (keys if name in self.uses.whole or c in read else carried)[c] = None
        if any(_holds_map(f.dataType) for f in rows.df.schema.fields if f.name in keys):
            return rows  # maps cannot be compared
        weight = new_slot("w")
        number = F.coalesce(F.sum(col(rows.weight)), F.lit(0).cast("bigint")) if rows.weight else F.count(F.lit(1))
        df = rows.df.groupBy(*map(col, keys)).agg(number.alias(weight), *[F.any_value(col(c)).alias(c) for c in carried])
        df = df if keys else df.where(col(weight) > 0)
        return replace(rows, df=df, scope=scope, weight=weight, held=tuple(v for v in scope if v in kept - values))

    @staticmethod
    def product(a: Rows, b: Rows) -> Rows:
        df, weight = a.df.crossJoin(b.df), a.weight or b.weight
        if a.weight and b.weight:
            weight = new_slot("w")
            df = df.withColumn(weight, col(a.weight) * col(b.weight)).drop(a.weight, b.weight)
        return replace(a, df=df, scope={**a.scope, **b.scope}, weight=weight, held=(*a.held, *b.held), sortable={}, order=(), output=None)

    def node(self, rows: Rows, n: A.NodePattern, nodes: set[str]) -> Rows:
        if n.var == rows.virtual:
            return rows
        if n.var in rows.scope:
            bound = rows.scope[n.var]
            if not isinstance(bound, Node):
                raise CypherTypeError(f"`{n.var}` is not a node")
            df = rows.df.where(bound.id.isNotNull())
            df = self.labelled(df, bound, n.labels)
            return rows.with_df(self.keep(df, bound, n.props, rows.scope))
        df, node = self.scan(n.var, n.labels, n.props)
        scope = {**rows.scope, n.var: node}
        if rows.df is None:
            return Rows(self.keep(df, node, n.props, scope), scope, held=(n.var,))
        free = not _uses(n.props)
        new = Rows(self.keep(df, node, n.props, scope) if free else df, {n.var: node}, held=(n.var,))
        rows = self.product(self.gathered(rows, nodes), self.gathered(new, nodes))
        return rows if free else rows.with_df(self.keep(rows.df, rows.scope[n.var], n.props, rows.scope))

    def hop(self, rows: Rows, near: A.NodePattern, e: A.EdgePattern, far: A.NodePattern, direction: str, nodes: set[str]) -> Rows:
        """``nodes`` are those that patterns come back to, the near one among them."""
        if e.hops:
            rows = self.many_hops(self.gathered(rows, nodes, near.var), near, e, far, direction)
            return replace(rows, held=(*rows.held, far.var))
        if e.var and e.var in rows.scope:
            raise CypherTypeError(f"`{e.var}` is bound already")
        a: Node = rows.scope[near.var]
        bound = rows.scope.get(far.var)
        tables = [(t, d) for d in (("out", "in") if direction == "both" else (direction,)) for t in self.catalog.edge_tables(e.types) if self._fits(t, d, a.tables, bound.tables if bound else None, far.labels)]
        fixed = ()
        if len(tables) == 1 and tables[0][0].key:
            fixed = ((near.var, far.var) if self._owns(*tables[0]) else (far.var, near.var),)
        if fixed != ((near.var, far.var),):
            rows = self.gathered(rows, nodes, near.var)
        rows = replace(rows, held=(*rows.held, far.var), fixed=rows.fixed + fixed)
        if len(tables) == 1 and not e.props and (step := self._by_key(rows, a, e, far, bound, *tables[0])):
            return step
        slot = new_slot("e")
        edges, edge = self.edges(tables, slot)
        near_key, far_key = (self._edge_key(tables, edge, end) for end in ("near", "far"))
        scope = {**rows.scope, **({e.var: edge} if e.var else {})}
        if rows.virtual:
            rows = self._landed(rows, a, edges, col(f"{slot}__near"), near_key, scope)
        else:
            same = col(a.key_column) == col(near_key) if near_key and a.key_column else a.id == col(f"{slot}__near")
            rows = rows.with_df(rows.df.join(edges, same), scope=scope)
        rows = rows.with_df(self.keep(rows.df, edge, e.props, {**rows.scope, e.var or "?": edge}))
        labels = {t.dst_label if d == "out" else t.src_label for t, d in tables}
        return self.arrive(rows, far, col(f"{slot}__far"), None if None in labels else labels, far_key)

    @staticmethod
    def _owns(t: EdgeTable, direction: str) -> bool:
        """Whether the near end's nodes hold the foreign key: each has one edge at most."""
        return t.key.owner == ("src" if direction == "out" else "dst")

    @staticmethod
    def _edge_key(tables: list[tuple[EdgeTable, str]], edge: Edge, end: str) -> str | None:
        """The edges' column that holds the key of the nodes at an end, if all tables agree on one."""
        keys = {t.src_key if (d == "out") == (end == "near") else t.dst_key for t, d in tables}
        (key,) = keys if len(keys) == 1 else (None,)
        return f"{edge.slot}_{key}" if key else None

    @staticmethod
    def _landed(rows: Rows, a: Node, found: DataFrame, near_id: Column, near_key: str | None, scope: dict[str, Any]) -> Rows:
        """Rows that begin with a hop: the near node's id, and its key if the hop has it, come from there."""
        found = found.withColumn(f"{a.slot}__id", near_id)
        if near_key and a.key:
            found = found.withColumn(f"{a.slot}_{a.key}", col(near_key))
        return Rows(found, scope, virtual=None, held=rows.held, fixed=rows.fixed)

    def _fits(self, t: EdgeTable, direction: str, near: tuple, far: tuple | None, labels: tuple[str, ...]) -> bool:
        """Whether an edge table can connect nodes of the label sets in question."""
        near_label, far_label = (t.src_label, t.dst_label) if direction == "out" else (t.dst_label, t.src_label)
        if near_label and not any(near_label in x for x in near):
            return False
        if far_label is None:
            return True
        if far is not None:
            return any(far_label in x for x in far)
        return any(set(labels) <= set(x.labels) for x in self.catalog.node_tables((far_label,)))

    def _by_key(self, rows: Rows, a: Node, e: A.EdgePattern, far: A.NodePattern, bound: Node | None, t: EdgeTable, direction: str) -> Rows | None:
        """A hop along a foreign key, if it needs no join with an edge table."""
        if t.key is None or len(self.catalog.node_tables((t.key.label,))) != 1:
            return None
        near_end = "src" if direction == "out" else "dst"
        slot = new_slot("e")
        if t.key.owner == near_end:
            if rows.virtual or a.props is None or t.key.prop not in a.props or any(t.key.label not in x for x in a.tables):
                return None
            far_id = t.key.other_id(lambda p: col(f"{a.slot}_{p}"))
            key = f"{a.slot}_{t.key.prop}"
            df = rows.df.where(col(key).isNotNull()).withColumn(f"{slot}__far", far_id)
            rows, far_col, owner = rows.with_df(df), col(f"{slot}__far"), a.id
            rows = self._key_edge(rows, e, slot, t, owner, *((a.id, far_col) if near_end == "src" else (far_col, a.id)))
            return self.arrive(rows, far, far_col, {t.dst_label if direction == "out" else t.src_label}, key)
        if bound is not None:
            return None
        tables = [x for x in self.catalog.node_tables((t.key.label, *far.labels))]
        df, node = self.scan(far.var, far.labels, far.props, tables, (f"{slot}__near", t.key.other_id))
        scope = {**rows.scope, far.var: node}
        free = not _uses(far.props)
        if free:
            df = self.keep(df, node, far.props, scope)
        key = f"{node.slot}_{t.key.prop}"
        if rows.virtual:
            joined = self._landed(rows, a, df.where(col(key).isNotNull()), col(f"{slot}__near"), key, scope).df
        else:
            same = col(a.key_column) == col(key) if a.key_column else a.id == col(f"{slot}__near")
            joined = rows.df.join(df, same)
        if not free:
            joined = self.keep(joined, node, far.props, scope)
        rows = replace(rows, virtual=None)
        rows = rows.with_df(joined, scope=scope)
        return self._key_edge(rows, e, slot, t, node.id, *((a.id, node.id) if near_end == "src" else (node.id, a.id)))

    @staticmethod
    def _key_edge(rows: Rows, e: A.EdgePattern, slot: str, t: EdgeTable, owner: Column, src: Column, dst: Column) -> Rows:
        if not e.var:
            return rows
        cols = {f"{slot}__eid": F.concat(F.lit(t.type + ":"), owner), f"{slot}__src": src, f"{slot}__dst": dst, f"{slot}__type": F.lit(t.type)}
        return rows.with_df(rows.df.withColumns(cols), scope={**rows.scope, e.var: Edge(slot, {}, (t.type,))})

    def edges(self, tables: list[tuple[EdgeTable, str]], slot: str) -> tuple[DataFrame, Edge]:
        """Edges of the tables, each seen in its direction: ``<slot>__near``, ``__far`` and the edge's own columns."""
        dfs = []
        for t, d in tables:
            near, far = ("_src", "_dst") if d == "out" else ("_dst", "_src")
            cols = [F.col(near).alias(f"{slot}__near"), F.col(far).alias(f"{slot}__far"), F.col("_eid").alias(f"{slot}__eid"), F.col("_src").alias(f"{slot}__src"), F.col("_dst").alias(f"{slot}__dst"), F.lit(t.type).alias(f"{slot}__type")]
            dfs.append(t.df.select(*cols, *[F.col(f"`{p}`").alias(f"{slot}_{p}") for p in t.props]))
        if not dfs:
            names = ("near", "far", "eid", "src", "dst", "type")
            return self.catalog.spark.createDataFrame([], ", ".join(f"{slot}__{n} string" for n in names)), Edge(slot, {})
        df = merged(dfs)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        props = {p: kinds[f"{slot}_{p}"] for t, _ in tables for p in t.props}
        return df, Edge(slot, props, tuple(dict.fromkeys(t.type for t, _ in tables)))

    def arrive(self, rows: Rows, far: A.NodePattern, far_id: Column, labels: set | None, far_key: str | None = None) -> Rows:
        """Binds the far node of a hop to an id; its node tables are joined only if more than the id is needed.

        ``far_key`` is a column with the far node's key, which is compared instead where the node has one.
        """
        if far.var in rows.scope:
            bound = rows.scope[far.var]
            df = self.labelled(rows.df.where(col(bound.key_column) == col(far_key) if far_key and bound.key_column else bound.id == far_id), bound, far.labels)
            return rows.with_df(self.keep(df, bound, far.props, rows.scope))
        tables = self.catalog.node_tables(far.labels)
        if labels is not None:
            tables = [t for t in tables if labels & set(t.labels)]
        certain = labels is not None and all(set(x.labels) >= set(far.labels) for label in labels for x in self.catalog.node_tables((label,)))
        if certain and not far.props and far.var not in self.full:
            slot = new_slot("n")
            key = tables[0].key if len(tables) == 1 and far_key else None
            node = Node(slot, None, tuple(t.labels for t in tables), key=key)
            cols = {f"{slot}__id": far_id} | ({f"{slot}_{key}": col(far_key)} if key else {})
            return rows.with_df(rows.df.withColumns(cols), scope={**rows.scope, far.var: node})
        df, node = self.scan(far.var, far.labels, far.props, tables)
        scope = {**rows.scope, far.var: node}
        same = col(node.key_column) == col(far_key) if far_key and node.key_column else far_id == node.id
        if not _uses(far.props):  # before the join: they do not depend on the rows
            return rows.with_df(rows.df.join(self.keep(df, node, far.props, scope), same), scope=scope)
        return rows.with_df(self.keep(rows.df.join(df, same), node, far.props, scope), scope=scope)

    # ----------------------------------------------------------------- variable length

    def many_hops(self, rows: Rows, near: A.NodePattern, e: A.EdgePattern, far: A.NodePattern, direction: str) -> Rows:
        """One row for each path whose nodes differ from each other and from the start; the edge variable stays unbound.

        If only the endpoints matter and the least length is one, a frontier search replaces the paths: each level
        keeps a row and an end once, and drops ends met before (any reachable end has a shortest, hence simple, path).
        """
        least, most = max(1, e.hops[0]), e.hops[1]
        if e.var and e.var in self.full:
            raise CypherTypeError(f"`{e.var}` is the variable of a variable-length pattern and cannot be used")
        if _uses(e.props):
            raise CypherTypeError("properties on a variable-length pattern must be constants")
        a: Node = rows.scope[near.var]
        slot = new_slot("p")
        both = ("out", "in") if direction == "both" else (direction,)
        tables = [(t, d) for t in self.catalog.edge_tables(e.types) for d in both]
        steps = merged([t.df.select(*[F.col(c).alias(n) for c, n in zip(("_src", "_dst") if d == "out" else ("_dst", "_src"), ("near", "far"), strict=True)]) for t, d in tables]) if tables else self.catalog.spark.createDataFrame([], "near string, far string")
        if e.props and tables:  # each edge of a path has them all
            steps = merged([self._with_props(t, d, e.props) for t, d in tables])
        search = self.endpoints_only and least == 1
        if search:
            steps = steps.distinct()
        here, seen = f"{slot}__here", f"{slot}__seen"
        frontier = rows.df.withColumn(here, a.id).withColumn(seen, F.array(a.id))
        identity = list(dict.fromkeys(b.identity for b in rows.scope.values()))
        visited, levels = None, []
        for depth in range(1, most + 1):
            frontier = frontier.join(steps, col(here) == F.col("near")).where(~F.array_contains(col(seen), F.col("far")))
            if search:
                frontier = frontier.withColumn(here, F.col("far")).drop("near", "far").dropDuplicates([*identity, here])
                if visited is not None:
                    names = frontier.columns
                    frontier = frontier.join(visited, [*identity, here], "left_anti").select(*[col(c) for c in names])
            else:
                frontier = frontier.withColumn(seen, F.concat(col(seen), F.array("far"))).withColumn(here, F.col("far")).drop("near", "far")
            stop = most > MOST_UNROLLED and (search or depth % MOST_UNROLLED == 0)
            if stop:
                frontier = written(frontier, "level")
            if search:
                mine = frontier.select(*identity, here)
                visited = mine if visited is None else visited.unionAll(mine)
            if depth >= least:
                levels.append(frontier)
            if stop and not has_rows(frontier):
                break
        df = levels[0] if levels else frontier.where(F.lit(False))
        for level in levels[1:]:
            df = df.unionAll(level)
        labels = {t.dst_label if d == "out" else t.src_label for t, d in tables}
        return self.arrive(rows.with_df(df.drop(seen)), far, col(here), None if None in labels else labels)

    def _with_props(self, t: EdgeTable, direction: str, props: tuple) -> DataFrame:
        slot = new_slot("e")
        df, edge = self.edges([(t, direction)], slot)
        return self.keep(df, edge, props, {}).select(col(f"{slot}__near").alias("near"), col(f"{slot}__far").alias("far"))

    # ----------------------------------------------------------------- optional and absent patterns

    def optional(self, rows: Rows, paths: tuple) -> Rows:
        """Left outer join with the whole pattern: rows without a match keep nulls for its new variables."""
        if rows.df is None:
            found = self.match(rows, paths)
            return found.with_df(self.catalog.spark.range(1).select().join(found.df, F.lit(True), "left"))
        found, on, plain = self._from_seed(rows, paths)
        new = {k: v for k, v in found.scope.items() if k not in rows.scope}
        carried = [c for b in new.values() for c in b.columns]
        right = found.df.select(*[col(c).alias(f"{c}~") for c in on], *[col(c) for c in carried])
        df = rows.df.join(right, _same(on, plain), "left").drop(*[f"{c}~" for c in on])
        return Rows(df, {**rows.scope, **new})

    def absent(self, rows: Rows, paths: tuple) -> Rows:
        """The rows without a match, as a left anti join; the pattern's variables are null."""
        found, on, plain = self._from_seed(rows, paths)
        new = {k: v for k, v in found.scope.items() if k not in rows.scope}
        kinds = {f.name: f.dataType for f in found.df.schema.fields}
        df = rows.df.join(found.df.select(*[col(c).alias(f"{c}~") for c in on]), _same(on, plain), "left_anti")
        df = df.withColumns({c: F.lit(None).cast(kinds[c]) for b in new.values() for c in b.columns})
        return Rows(df, {**rows.scope, **new})

    def _from_seed(self, rows: Rows, paths: tuple) -> tuple[Rows, list[str], bool]:
        """The pattern's matches, the columns that join them to the rows, and whether all of these identify nodes.

        If one bound node at an end of a single path of single hops is all the pattern shares with the rows, the
        matches start from the edges themselves and meet the rows in that one join.
        """
        bound = {n.var for p in paths for n in p.nodes if n.var in rows.scope} | {e.var for p in paths for e in p.edges if e.var in rows.scope}
        used = set().union(*[_names(part.props) for p in paths for part in (*p.nodes, *p.edges)]) & set(rows.scope)
        if len(paths) == 1 and len(bound) == 1 and not used and paths[0].edges and not any(e.hops for e in paths[0].edges):
            (var,) = bound
            nodes = paths[0].nodes
            where = [i for i, n in enumerate(nodes) if n.var == var]
            node = rows.scope[var]
            if isinstance(node, Node) and where in ([0], [len(nodes) - 1]) and not nodes[where[0]].props and all(set(nodes[where[0]].labels) <= set(t) for t in node.tables):
                alone = replace(node, props=None, has_vector=False, key=node.key if node.key_column else None)
                found = self.match(Rows(None, {var: alone}, virtual=var), paths)
                if node.key_column and node.key_column in found.df.columns:
                    return found, [node.key_column], True
                return found, [f"{node.slot}__id"], True
        seed, on = self._seed(rows, paths)
        return self.match(seed, paths), on, False

    def _seed(self, rows: Rows, paths: tuple) -> tuple[Rows, list[str]]:
        """What the pattern needs of the rows, once each, and the columns that join its matches back."""
        used: set[str] = set()
        for p in paths:
            for part in (*p.nodes, *p.edges):
                used |= _names(part.props)
                if part.var:
                    used.add(part.var)
        scope = {k: v for k, v in rows.scope.items() if k in used}
        on = [c for b in scope.values() for c in (b.columns if isinstance(b, Scalar) else b.columns[:1])]
        if not on:
            return Rows(), on
        # a bound node brings its other columns along only if the pattern reads them
        thin = {k: replace(v, props=None, has_vector=False, key=None) if isinstance(v, Node) and not self._reads(k, v, paths) else v for k, v in scope.items()}
        columns = [c for b in thin.values() for c in b.columns]
        seed = rows.df.select(*[col(c) for c in columns])
        present = [v.id for v in thin.values() if not isinstance(v, Scalar)]
        for p in present:
            seed = seed.where(p.isNotNull())
        return Rows(seed.dropDuplicates(on), thin), on

    def _reads(self, var: str, node: Node, paths: tuple) -> bool:
        for p in paths:
            for i, n in enumerate(p.nodes):
                if any(var in _names(part.props) for part in (*p.nodes, *p.edges)):
                    return True
                if n.var == var:
                    if n.props or n.labels and not all(set(n.labels) <= set(t) for t in node.tables):
                        return True
                    for t in self.catalog.edges:  # its foreign keys may spare a join
                        if t.key and any(t.key.label in x for x in node.tables) and (i < len(p.edges) or i > 0):
                            near = [e for e in (p.edges[i : i + 1] + p.edges[max(0, i - 1) : i]) if not e.types or t.type in e.types]
                            if near and node.props is not None:
                                return True
        return False


def _holds_map(kind: T.DataType) -> bool:
    match kind:
        case T.ArrayType():
            return _holds_map(kind.elementType)
        case T.StructType():
            return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def _names(props: tuple) -> set[str]:
    from ..functions.expressions import variables_in

    return set().union(*[variables_in(e) for _, e in props])


def _uses(props: tuple) -> bool:
    return bool(_names(props))


def _same(on: list[str], plain: bool) -> Column:
    """Join condition for columns and their copies; ids are compared plainly, as null ids match nothing."""
    out = F.lit(True)
    for c in on:
        out = out & (col(c) == col(f"{c}~") if plain or c.endswith(("__id", "__eid")) else col(c).eqNullSafe(col(f"{c}~")))
    return out
