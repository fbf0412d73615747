"""Syntax tree of the query language.  All nodes are immutable, so that equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# --------------------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    of: Any
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Negative:
    of: Any


@dataclass(frozen=True)
class IsNull:
    of: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    operand: Any
    branches: tuple
    otherwise: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


# --------------------------------------------------------------------------- patterns


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple
    props: tuple  # of (key, expression)


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    types: tuple
    props: tuple
    direction: str  # out, in, both
    hops: tuple | None = None  # (least, most) of a variable-length pattern


@dataclass(frozen=True)
class Path:
    nodes: tuple
    edges: tuple


# --------------------------------------------------------------------------- clauses


@dataclass(frozen=True)
class Match:
    paths: tuple
    optional: bool = False


@dataclass(frozen=True)
class Where:
    condition: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None


@dataclass(frozen=True)
class Project:
    items: tuple
    distinct: bool
    final: bool  # RETURN, not WITH


@dataclass(frozen=True)
class OrderBy:
    keys: tuple  # of (expression, descending)


@dataclass(frozen=True)
class Skip:
    count: Any


@dataclass(frozen=True)
class Limit:
    count: Any


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str


@dataclass(frozen=True)
class CallProcedure:
    name: str
    args: tuple
    yields: tuple  # of (name, alias)


@dataclass(frozen=True)
class Create:
    paths: tuple


@dataclass(frozen=True)
class Merge:
    node: NodePattern
    on_create: tuple = ()
    on_match: tuple = ()


@dataclass(frozen=True)
class SetProps:
    items: tuple  # of (variable, key, expression)


@dataclass(frozen=True)
class RemoveProps:
    items: tuple  # of (variable, key)


@dataclass(frozen=True)
class Delete:
    targets: tuple
    detach: bool


@dataclass
class Statement:
    clauses: list = field(default_factory=list)


def children(e: Any) -> list:
    """The expressions directly below an expression."""
    match e:
        case Property(of, _) | Not(of) | Negative(of) | IsNull(of, _):
            return [of]
        case Binary(_, left, right):
            return [left, right]
        case Case(operand, branches, otherwise):
            return [x for x in (operand, *[y for b in branches for y in b], otherwise) if x is not None]
        case ListOf(items):
            return list(items)
        case MapOf(items):
            return [v for _, v in items]
        case Call(_, args):
            return list(args)
    return []
