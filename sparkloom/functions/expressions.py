"""Expressions of the query language as Spark columns, typed when the plan is built."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CypherTypeError
from ..plans import ast as A
from . import values as V
from . import vectors
from .values import Value

AGGREGATES = frozenset({"count", "collect", "sum", "avg", "min", "max"})

#: Scalar functions by lower-case name: from argument values to a value.  Others may be added.
SCALARS: dict[str, Callable[..., Value]] = {}


def scalar(name: str) -> Callable:
    def add(f: Callable[..., Value]) -> Callable[..., Value]:
        SCALARS[name.lower()] = f
        return f

    return add


@scalar("id")
def _id(x: Value) -> Value:
    return Value(x.entity.id, "string") if x.entity else V.null()


@scalar("labels")
def _labels(x: Value) -> Value:
    return Value(x.entity.labels, "list", item=Value(x.entity.labels, "string")) if x.type == "node" else V.null()


@scalar("type")
def _type(x: Value) -> Value:
    return Value(x.entity.type, "string") if x.type == "edge" else V.null()


@scalar("toInteger")
def _to_integer(x: Value) -> Value:
    """Whole numbers stay, floats are cut off, strings must be whole numbers throughout (an error otherwise)."""
    if x.type == "int":
        return x
    if x.type == "float":
        limit = float(2**63)
        cut = F.when(x.col >= limit, F.lit(2**63 - 1)).when(x.col <= -limit, F.lit(-(2**63))).when(F.isnan(x.col), F.lit(0))
        return Value(cut.otherwise(x.col.try_cast("bigint")).cast("bigint"), "int")
    if x.type == "string":
        bad = F.raise_error(F.concat(F.lit("toInteger: not a whole number: "), x.col)).cast("bigint")
        return Value(F.when(x.col.isNull(), F.lit(None)).when(x.col.rlike(r"^[+-]?[0-9]+$"), x.col.try_cast("bigint")).otherwise(bad).cast("bigint"), "int")
    return V.null()


@scalar("toString")
def _to_string(x: Value) -> Value:
    """Null becomes 'null', floats with a whole value lose their decimals and exponent."""
    if x.type == "null":
        return Value(F.lit("null"), "string")
    col = x.entity.id if x.entity else x.col
    if x.type == "float":
        whole = (F.abs(col) < 1e15) & (col == F.floor(col))
        big = F.regexp_replace(col.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        text = F.when(whole, F.when(whole, col.cast("bigint")).cast("string")).when((F.abs(col) < 1e-3) | ((F.abs(col) >= 1e7) & (F.abs(col) < 1e27)), big).otherwise(col.cast("string"))
    else:
        text = F.to_json(F.struct(col.alias("v"))) if x.type in ("list", "map") else col.cast("string")
    return Value(F.coalesce(text, F.lit("null")), "string")


def _vector(x: Value) -> Column | None:
    """A node's or an edge's own vector, or a list of numbers."""
    if x.type == "node":
        return x.entity.vector
    if x.type == "list" and x.item is not None and x.item.type in (*V.NUMBERS, "null"):
        return x.col
    return None


def _on_vectors(kernel: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    def call(a: Value, b: Value) -> Value:
        x, y = _vector(a), _vector(b)
        return V.null() if x is None or y is None else Value(kernel(x, y), "float")

    return call


def _similarity(a: Value, b: Value) -> Value:
    x, y = _vector(a), _vector(b)
    return V.null() if x is None or y is None else Value(vectors.cosine(x, y, constant_norm(a), constant_norm(b)), "float")


def constant_norm(v: Value) -> Column | None:
    """The norm of a vector that is a constant, so that it is not computed for each row."""
    if not isinstance(v.literal, list) or not all(isinstance(x, (int, float)) for x in v.literal):
        return None
    return F.lit(math.sqrt(sum(float(x) * float(x) for x in v.literal)))


SCALARS["vector_similarity"] = _similarity
SCALARS["vector_distance"] = _on_vectors(vectors.euclidean)
SCALARS["dot_product"] = _on_vectors(vectors.dot)

VECTOR_FUNCTIONS = frozenset({"vector_similarity", "vector_distance", "dot_product"})


def has_aggregate(e: Any) -> bool:
    return isinstance(e, A.Call) and e.name in AGGREGATES or any(map(has_aggregate, A.children(e)))


def variables_in(e: Any) -> set[str]:
    return {e.name} if isinstance(e, A.Variable) else set().union(*map(variables_in, A.children(e)))


class Compiler:
    """Compiles expressions over a scope (names to values) and parameters.

    ``known`` maps whole expressions to values that exist already (grouping keys, aggregates, repeated kernels).
    """

    def __init__(self, scope: dict[str, Any], params: dict[str, Any], known: dict[Any, Value] | None = None):
        self.scope, self.params, self.known = scope, params, known or {}

    def __call__(self, e: Any) -> Value:
        if e in self.known:
            return self.known[e]
        match e:
            case A.Literal(x):
                return V.constant(x)
            case A.Parameter(name):
                return V.constant(self.params.get(name))
            case A.Variable(name):
                if name not in self.scope:
                    raise CypherTypeError(f"variable `{name}` is not defined")
                return self.scope[name].value()
            case A.Property(of, name):
                return self.property(self(of), name)
            case A.Binary("AND", left, right):
                return Value(self.truth(left) & self.truth(right), "bool")
            case A.Binary("OR", left, right):
                return Value(self.truth(left) | self.truth(right), "bool")
            case A.Binary("=" | "<>" | "<" | ">" | "<=" | ">=" | "IN" | "CONTAINS" | "STARTS" | "ENDS"):
                return Value(self.test(e, plain=False), "bool")
            case A.Binary(op, left, right):
                return V.arithmetic(op, self(left), self(right))
            case A.Not(of):
                return Value(~self.truth(of), "bool")
            case A.Negative(of):
                v = self(of)
                return Value(-v.col, v.type) if v.type in V.NUMBERS else V.null()
            case A.IsNull(of, negated):
                v = self(of)
                out = F.lit(True) if v.type == "null" else (v.entity.id if v.entity else v.col).isNull()
                return Value(~out if negated else out, "bool")
            case A.Case():
                return self.case(e)
            case A.ListOf(items):
                return V.list_of([self.stored(x) for x in items])
            case A.MapOf(items):
                return V.map_of({k: self.stored(x) for k, x in items})
            case A.Call(name, args):
                if name in AGGREGATES:
                    raise CypherTypeError(f"{name}(...) can only be used in RETURN and WITH")
                if name not in SCALARS:
                    raise CypherTypeError(f"unknown function {name}")
                try:
                    return SCALARS[name](*[self.argument(name, x) for x in args])
                except TypeError as err:
                    raise CypherTypeError(f"wrong arguments for {name}: {err}") from err
        raise CypherTypeError(f"cannot compile {e!r}")

    def argument(self, function: str, e: Any) -> Value:
        """An argument; for vector functions any property of a node that has a vector means that vector."""
        v = self(e)
        if function in VECTOR_FUNCTIONS and isinstance(e, A.Property) and isinstance(e.of, A.Variable):
            of = self(e.of)
            if of.type == "node" and of.entity.vector is not None:
                return of
        return v

    def stored(self, e: Any) -> Value:
        """A value as it stands in a list or map: entities by a struct."""
        v = self(e)
        return v.entity.as_struct() if v.entity else v

    def truth(self, e: Any) -> Column:
        return V.truthy(self(e))

    def test(self, e: A.Binary, plain: bool) -> Column:
        a, b = self(e.left), self(e.right)
        if e.op == "=":
            return V.equal(a, b, plain)
        if e.op == "<>":
            return ~V.equal(a, b)
        if e.op == "IN":
            return V.member(a, b)
        if e.op in ("CONTAINS", "STARTS", "ENDS"):
            return V.text_test(e.op, a, b, plain)
        return V.ordered(e.op, a, b, plain)

    def condition(self, e: Any) -> list[Column]:
        """Conjuncts of a filter.  As null and false filter alike, they are left in the form that scans push down."""
        if isinstance(e, A.Binary) and e.op == "AND":
            return self.condition(e.left) + self.condition(e.right)
        if isinstance(e, A.Binary) and e.op in ("=", "<", ">", "<=", ">=", "CONTAINS", "STARTS", "ENDS"):
            return [self.test(e, plain=True)]
        return [self.truth(e)]

    def property(self, of: Value, name: str) -> Value:
        if of.entity:
            return of.entity.property(name)
        if of.type == "map":
            if of.fields is not None:
                return of.fields.get(name, V.null())
            return Value(F.element_at(of.col, name), "other")
        return V.null()

    def case(self, e: A.Case) -> Value:
        operand = self(e.operand) if e.operand is not None else None
        results = V.widest([self(r) for _, r in e.branches] + [self(e.otherwise) if e.otherwise is not None else V.null()], "CASE")
        out = None
        for (when, _), result in zip(e.branches, results, strict=False):
            test = V.equal(operand, self(when)) if operand is not None else self.truth(when)
            out = F.when(test, result.col) if out is None else out.when(test, result.col)
        shape = next((r for r in results if r.type != "null"), V.null())
        return Value(out.otherwise(results[-1].col), shape.type, item=shape.item, fields=shape.fields)
