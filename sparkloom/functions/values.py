"""Typed values of the query language and their rules: two-valued equality, truthiness, arithmetic without errors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError

NUMBERS = ("int", "float")


@dataclass
class Value:
    """A column with its static type: null, bool, int, float, string, list, map, node, edge or other."""

    col: Column
    type: str
    item: Value | None = None  # of a list: an element (its column is not used)
    fields: dict[str, Value] | None = None  # of a map literal
    entity: Any = None  # of a node or edge: its binding
    literal: Any = None  # a constant that is not null


def null() -> Value:
    return Value(F.lit(None), "null")


def constant(x: Any) -> Value:
    """A literal or a parameter's value."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), "bool", literal=x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), "int", literal=x)
    if isinstance(x, float):
        return Value(F.lit(x), "float", literal=x)
    if isinstance(x, str):
        return Value(F.lit(x), "string", literal=x)
    if isinstance(x, (list, tuple)):
        out = list_of([constant(v) for v in x])
        out.literal = list(x)
        return out
    if isinstance(x, dict):
        return map_of({str(k): constant(v) for k, v in x.items()})
    raise CypherTypeError(f"a parameter cannot be of type {type(x).__name__}")


def of_type(col: Column, data: T.DataType) -> Value:
    """A column's value by its Spark type; whole numbers become bigint, others double."""
    if isinstance(data, T.BooleanType):
        return Value(col, "bool")
    if isinstance(data, (T.ByteType, T.ShortType, T.IntegerType)):
        return Value(col.cast("bigint"), "int")
    if isinstance(data, T.LongType):
        return Value(col, "int")
    if isinstance(data, T.DoubleType):
        return Value(col, "float")
    if isinstance(data, (T.FloatType, T.DecimalType)):
        return Value(col.cast("double"), "float")
    if isinstance(data, T.StringType):
        return Value(col, "string")
    if isinstance(data, T.ArrayType):
        return Value(col, "list", item=of_type(col, data.elementType))
    if isinstance(data, T.StructType):
        return Value(col, "map", fields={f.name: of_type(col[f.name], f.dataType) for f in data.fields})
    if isinstance(data, T.MapType):
        return Value(col, "map")
    if isinstance(data, T.NullType):
        return Value(col, "null")
    return Value(col, "other")


def widest(values: list[Value], what: str) -> list[Value]:
    """The values at one type: null fits anything, whole numbers widen to floats."""
    kinds = {v.type for v in values} - {"null"}
    if len(kinds) > 1 and kinds <= set(NUMBERS):
        return [Value(v.col.cast("double"), "float", literal=v.literal) for v in values]
    if len(kinds) > 1:
        raise CypherTypeError(f"{what} mixes the types {', '.join(sorted(kinds))}")
    return values


def list_of(items: list[Value]) -> Value:
    items = widest(items, "a list")
    item = next((v for v in items if v.type != "null"), null())
    col = F.array(*[v.col for v in items]) if items else F.array().cast("array<string>")
    return Value(col, "list", item=item)


def map_of(fields: dict[str, Value]) -> Value:
    return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.create_map(), "map", fields=fields)


# --------------------------------------------------------------------------- equality, order, truth


def equal(a: Value, b: Value, plain: bool = False) -> Column:
    """``a = b`` in two values; ``plain`` allows null instead of false (as a whole filter condition)."""
    if a.type == "null" and b.type == "null":
        return F.lit(True)
    if "null" in (a.type, b.type):
        v = b if a.type == "null" else a
        return (v.entity.id if v.entity else v.col).isNull()
    if a.entity or b.entity:
        return a.entity.id.eqNullSafe(b.entity.id) if a.entity and b.entity and a.type == b.type else F.lit(False)
    left, right = a.col, b.col
    if a.type != b.type:
        if not {a.type, b.type} <= set(NUMBERS):
            return left.isNull() & right.isNull()
        left, right = left.cast("double"), right.cast("double")
    if plain and (a.literal is not None or b.literal is not None):
        return left == right
    return left.eqNullSafe(right)


def ordered(op: str, a: Value, b: Value, plain: bool = False) -> Column:
    """``a op b`` for < > <= >=: false with nulls or types that have no common order."""
    if a.type != b.type and not {a.type, b.type} <= set(NUMBERS) or a.type not in ("bool", "int", "float", "string", "other"):
        return F.lit(False)
    out = {"<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[op]
    return out if plain else F.coalesce(out, F.lit(False))


def truthy(v: Value) -> Column:
    """false, null, 0 and the empty string are falsy; all else is truthy."""
    if v.type == "null":
        return F.lit(False)
    if v.entity:
        return v.entity.id.isNotNull()
    if v.type == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.type == "int":
        return F.coalesce(v.col != 0, F.lit(False))
    if v.type == "string":
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def member(a: Value, items: Value) -> Column:
    """``a IN items`` by the equality above; false if items is no list."""
    if items.type != "list":
        return F.lit(False)
    if isinstance(items.literal, list) and items.literal and None not in items.literal and a.type == items.item.type and a.type in ("int", "string", "bool"):
        return F.coalesce(a.col.isin(items.literal), F.lit(False))
    test = lambda x: equal(a, Value(x, items.item.type if items.item else "null", item=items.item.item if items.item else None))
    return F.coalesce(F.exists(items.col, test), F.lit(False))


def text_test(op: str, a: Value, b: Value, plain: bool = False) -> Column:
    if a.type != "string" or b.type != "string":
        return F.lit(False)
    out = {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith}[op](a.col, b.col)
    return out if plain else F.coalesce(out, F.lit(False))


# --------------------------------------------------------------------------- arithmetic


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and a.type == b.type == "string":
        return Value(F.concat(a.col, b.col), "string")
    if a.type not in NUMBERS or b.type not in NUMBERS:
        return null()
    whole = a.type == b.type == "int"
    if op in "+-*":
        return Value({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "int" if whole else "float")
    if whole:
        out = F.call_function("div", a.col, b.col) if op == "/" else a.col % b.col
        return Value(F.when(b.col != 0, out.cast("bigint")), "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    nan = F.lit(float("nan"))
    if op == "%":
        return Value(F.when(y == 0, F.when(x.isNotNull(), nan)).otherwise(x % y), "float")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), nan)
    return Value(F.when(y == 0, at_zero).otherwise(x / y), "float")
