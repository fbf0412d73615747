"""RETURN and WITH: projection, DISTINCT, implicit grouping, and the sort keys of a following ORDER BY."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CypherTypeError
from ..functions import values as V
from ..functions.expressions import AGGREGATES, Compiler, has_aggregate
from ..functions.values import Value
from ..plans import ast as A
from .rows import Rows, Scalar, col, new_slot, shaped


def derived_name(e: Any) -> str:
    match e:
        case A.Variable(name):
            return name
        case A.Property(of, name):
            return f"{derived_name(of)}.{name}"
        case A.Call(name, _):
            return f"{name}(..)"
    return "expr"


def output_names(items: tuple) -> list[str]:
    """Aliases or derived names; a repeated name gets a number."""
    out: list[str] = []
    for item in items:
        name = base = item.alias or derived_name(item.expr)
        n = 1
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def project(rows: Rows, clause: A.Project, params: dict[str, Any], sort_keys: tuple, spark) -> Rows:
    items = list(clause.items)
    if any(isinstance(i.expr, A.Variable) and i.expr.name == "*" for i in items):
        items = [x for i in items for x in ([A.Item(A.Variable(n), n) for n in rows.scope] if isinstance(i.expr, A.Variable) and i.expr.name == "*" else [i])]
    items = tuple(items)
    names = output_names(items)
    if any(has_aggregate(i.expr) for i in items):
        done = _aggregate(rows, items, names, params, spark)
    else:
        done = _plain(rows, items, names, params, sort_keys if not clause.distinct else (), spark)
    if clause.distinct:
        done = done.with_df(done.df.dropDuplicates(list(dict.fromkeys(b.identity for b in done.scope.values()))))
    if clause.final:
        done = replace(done, output=tuple((n, done.scope[n]) for n in names))
    return done


def _bind(v: Value, known: dict[str, Any]) -> tuple[Any, list[Column]]:
    """What a projected value is bound to, and the columns that it needs: entities keep theirs."""
    if v.entity:
        return v.entity, [col(c) for c in v.entity.columns]
    slot = new_slot("s")
    c = F.lit(None).cast("string") if v.type == "null" else v.col
    return Scalar(slot, v.type, v.item, v.fields), [c.alias(slot)]


def _plain(rows: Rows, items: tuple, names: list[str], params: dict[str, Any], sort_keys: tuple, spark) -> Rows:
    compiler = Compiler(rows.scope, params, rows.known)
    scope, columns, sortable = {}, {}, {}
    for item, name in zip(items, names, strict=True):
        binding, cols = _bind(compiler(item.expr), scope)
        scope[name] = binding
        for c, n in zip(cols, binding.columns, strict=True):
            columns[n] = c
        if not isinstance(item.expr, A.Literal):
            sortable[item.expr] = binding.value()
    # sort keys that are no projected name are kept as hidden columns
    for e, _ in sort_keys:
        if e in sortable or isinstance(e, A.Variable) and e.name in scope:
            continue
        try:
            Compiler(scope, params, sortable)(e)
        except CypherTypeError:
            v = compiler(e)
            slot = new_slot("h")
            columns[slot] = (v.entity.id if v.entity else v.col).alias(slot)
            sortable[e] = shaped(col(slot), v)
    df = rows.start(spark).select(*columns.values())
    return Rows(df, scope, sortable, rows.order if all(c in columns for c, _ in rows.order) else ())


def _calls(e: Any, out: dict[A.Call, None]) -> None:
    if isinstance(e, A.Call) and e.name in AGGREGATES:
        out[e] = None
    else:
        for x in A.children(e):
            _calls(x, out)


def _aggregate(rows: Rows, items: tuple, names: list[str], params: dict[str, Any], spark) -> Rows:
    compiler = Compiler(rows.scope, params, rows.known)
    df: DataFrame = rows.start(spark)
    known: dict[Any, Value] = {}
    scope: dict[str, Any] = {}
    inner: dict[str, Any] = {}  # variables that are keys, for expressions around aggregates
    keys, carried = [], []
    for item, name in zip(items, names, strict=True):
        if has_aggregate(item.expr):
            continue
        v = compiler(item.expr)
        if v.entity:
            # grouped by identity; the other columns are the same throughout a group
            keys.append(col(v.entity.identity))
            carried += [F.any_value(col(c)).alias(c) for c in v.entity.columns if c != v.entity.identity]
            binding = v.entity
        else:
            slot = new_slot("k")
            keys.append((F.lit(None).cast("string") if v.type == "null" else v.col).alias(slot))
            binding = Scalar(slot, v.type, v.item, v.fields)
        scope[name] = binding
        known[item.expr] = binding.value()
        if isinstance(item.expr, A.Variable):
            inner[item.expr.name] = binding
    calls: dict[A.Call, None] = {}
    for item in items:
        _calls(item.expr, calls)
    aggs = []
    for call in calls:
        slot = new_slot("a")
        v = aggregate(call, compiler, rows.order, rows.weight, set(df.columns))
        aggs.append(v.col.alias(slot))
        known[call] = shaped(col(slot), v)
    unique = {str(k): k for k in keys}
    df = df.groupBy(*unique.values()).agg(*aggs, *carried) if keys else df.agg(*aggs)
    after = Compiler(inner, params, known)
    added = {}
    for item, name in zip(items, names, strict=True):
        if has_aggregate(item.expr):
            v = after(item.expr)
            slot = new_slot("s")
            added[slot] = v.col
            scope[name] = Scalar(slot, v.type, v.item, v.fields)
    df = df.withColumns(added)
    scope = {n: scope[n] for n in names}
    return Rows(df, scope, {**known, **{i.expr: scope[n].value() for i, n in zip(items, names, strict=True)}})


def aggregate(call: A.Call, compiler: Compiler, order: tuple, weight: str | None = None, present: set[str] | None = None) -> Value:
    """The value over a group's rows; with a ``weight`` each row counts that often, and nodes of which only their number is asked are not among the columns ``present``."""
    name = call.name
    if weight and not call.distinct and name == "count":
        v = Value(F.lit(1), "int") if call.star else compiler(call.args[0])
        c = col(v.entity.identity) if v.entity else v.col
        here = col(weight) if v.entity and v.entity.identity not in present else F.when(c.isNotNull(), col(weight))
        return Value(F.coalesce(F.sum(here), F.lit(0).cast("bigint")), "int")
    if call.star:
        if name != "count":
            raise CypherTypeError(f"{name}(*) is not an aggregate")
        return Value(F.count(F.lit(1)), "int")
    if len(call.args) != 1:
        raise CypherTypeError(f"{name} takes one argument")
    v = compiler(call.args[0])
    c = v.entity.id if v.entity else v.col
    match name:
        case "count" if v.entity:
            c = col(v.entity.identity)
            return Value(F.count_distinct(c) if call.distinct else F.count(c), "int")
        case "count":
            return Value(F.count_distinct(c) if call.distinct else F.count(c), "int")
        case "collect":
            item = v.entity.as_struct() if v.entity else v
            return _collect(item, order)
        case "sum":
            if v.type not in V.NUMBERS:
                return Value(F.coalesce(F.max(F.lit(0).cast("bigint")), F.lit(0).cast("bigint")), "int")
            return Value(F.coalesce(F.sum(c * col(weight) if weight else c), F.lit(0).cast("bigint" if v.type == "int" else "double")), v.type)
        case "avg" if weight and v.type in V.NUMBERS:
            return Value(F.sum(c.cast("double") * col(weight)) / F.sum(F.when(c.isNotNull(), col(weight))), "float")
        case "avg":
            return Value(F.avg(c.cast("double")) if v.type in V.NUMBERS else F.max(F.lit(None).cast("double")), "float")
        case "min" | "max":
            if v.entity or v.type in ("list", "map", "null"):
                return Value(F.max(F.lit(None).cast("string")), "null")
            return Value(F.min(c) if name == "min" else F.max(c), v.type)
    raise CypherTypeError(f"unknown aggregate {name}")


def _collect(v: Value, order: tuple) -> Value:
    """All values, nulls too; in the order of the sort keys in force, as rows have no order of their own."""
    of = v.col if v.type != "null" else F.lit(None).cast("string")
    keys = [col(c).alias(f"k{i}") for i, (c, _) in enumerate(order)]
    packed = F.collect_list(F.struct(*keys, of.alias("v")))
    if keys:
        packed = F.array_sort(packed, lambda a, b: _compare(a, b, order))
    return Value(F.transform(packed, lambda x: x["v"]), "list", item=v)


def _compare(a: Column, b: Column, order: tuple) -> Column:
    out = F.lit(0)
    for i, (_, descending) in reversed(list(enumerate(order))):
        x, y = a[f"k{i}"], b[f"k{i}"]
        less, more = (1, -1) if descending else (-1, 1)
        # null counts as the largest: last when ascending, first when descending
        out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), more).when(y.isNull(), less).when(x < y, less).when(x > y, more).otherwise(out)
    return out


def sort(rows: Rows, keys: tuple, params: dict[str, Any]) -> Rows:
    compiler = Compiler(rows.scope, params, rows.sortable)
    columns, order, added = [], [], {}
    for e, descending in keys:
        v = compiler(e)
        c = v.entity.id if v.entity else v.col
        slot = new_slot("o")
        added[slot] = c if v.type != "null" else F.lit(None).cast("string")
        columns.append(col(slot).desc_nulls_first() if descending else col(slot).asc_nulls_last())
        order.append((slot, descending))
    return rows.with_df(rows.df.withColumns(added).orderBy(*columns), order=tuple(order))


def result(rows: Rows) -> DataFrame:
    """The output columns of a RETURN under their names; entities as structs."""
    cols = []
    for name, b in rows.output:
        v = b.value()
        v = v.entity.as_struct() if v.entity else v
        cols.append(v.col.alias(name))
    return rows.df.select(*cols)


__all__ = ["aggregate", "output_names", "project", "result", "sort"]
