"""The working set of a query: a DataFrame and what each variable means in it."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.values import Value

_numbers = itertools.count()


def new_slot(kind: str) -> str:
    """A column prefix that no other part of any plan uses, so that joins have no names in common."""
    return f"{kind}{next(_numbers)}"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Node:
    """A node variable: columns ``<slot>__id``, ``<slot>__labels``, ``<slot>__vec`` and ``<slot>_<property>``.

    ``props`` is None if only the id (and the key, if known) is there: no expression asks for more.  ``tables`` are the label sets it can have.
    """

    slot: str
    props: dict[str, T.DataType] | None
    tables: tuple[tuple[str, ...], ...]
    has_vector: bool = False
    key: str | None = None  # a property that stands for the id

    @property
    def id(self) -> Column:
        return col(f"{self.slot}__id")

    @property
    def labels(self) -> Column:
        return col(f"{self.slot}__labels")

    @property
    def vector(self) -> Column | None:
        return col(f"{self.slot}__vec") if self.has_vector else None

    @property
    def key_column(self) -> str | None:
        return f"{self.slot}_{self.key}" if self.key and (self.props is None or self.key in self.props) else None

    @property
    def identity(self) -> str:
        """The column that tells nodes apart at least cost."""
        return self.key_column or f"{self.slot}__id"

    @property
    def columns(self) -> list[str]:
        if self.props is None:
            return [f"{self.slot}__id", *([f"{self.slot}_{self.key}"] if self.key else [])]
        return [f"{self.slot}__id", f"{self.slot}__labels", *[f"{self.slot}_{p}" for p in self.props], *([f"{self.slot}__vec"] if self.has_vector else [])]

    def property(self, name: str) -> Value:
        if name not in (self.props or {}):
            return V.null()
        return V.of_type(col(f"{self.slot}_{name}"), self.props[name])

    def value(self) -> Value:
        return Value(self.id, "node", entity=self)

    def as_struct(self) -> Value:
        fields = {"id": Value(self.id, "string")}
        if self.props is not None:
            fields["labels"] = Value(self.labels, "list", item=Value(self.id, "string"))
            fields["properties"] = V.map_of({p: Value(self.property(p).col, self.property(p).type) for p in self.props})
        return Value(F.when(self.id.isNotNull(), V.map_of(fields).col), "map", fields=None)


@dataclass(frozen=True)
class Edge:
    """A relationship variable: ``<slot>__eid``, ``__src``, ``__dst``, ``__type`` and properties."""

    slot: str
    props: dict[str, T.DataType]
    types: tuple[str, ...] = ()

    @property
    def id(self) -> Column:
        return col(f"{self.slot}__eid")

    @property
    def type(self) -> Column:
        return col(f"{self.slot}__type")

    @property
    def identity(self) -> str:
        return f"{self.slot}__eid"

    vector = None

    @property
    def columns(self) -> list[str]:
        return [f"{self.slot}{c}" for c in ("__eid", "__src", "__dst", "__type")] + [f"{self.slot}_{p}" for p in self.props]

    def property(self, name: str) -> Value:
        return V.of_type(col(f"{self.slot}_{name}"), self.props[name]) if name in self.props else V.null()

    def value(self) -> Value:
        return Value(self.id, "edge", entity=self)

    def as_struct(self) -> Value:
        fields = {"id": Value(self.id, "string"), "source": Value(col(f"{self.slot}__src"), "string"), "target": Value(col(f"{self.slot}__dst"), "string"), "type": Value(self.type, "string")}
        fields["properties"] = V.map_of({p: Value(self.property(p).col, self.property(p).type) for p in self.props})
        return Value(F.when(self.id.isNotNull(), V.map_of(fields).col), "map", fields=None)


@dataclass(frozen=True)
class Scalar:
    """A variable with a value: one column."""

    name: str
    type: str
    item: Value | None = None
    fields: dict[str, Value] | None = None

    @property
    def columns(self) -> list[str]:
        return [self.name]

    @property
    def identity(self) -> str:
        return self.name

    def value(self) -> Value:
        return shaped(col(self.name), self)


def shaped(c: Column, like: Any) -> Value:
    """A column with the static type of another value."""
    fields = None if like.fields is None else {k: shaped(c[k], v) for k, v in like.fields.items()}
    return Value(c, like.type, item=like.item, fields=fields)


@dataclass(frozen=True)
class Rows:
    """``df`` is None for the single empty row that a statement starts with."""

    df: DataFrame | None = None
    scope: dict[str, Any] = field(default_factory=dict)
    #: Expressions that the last projection left as columns, and those its ORDER BY may use.
    sortable: dict[Any, Value] = field(default_factory=dict)
    #: Costly expressions over the variables in scope that are columns already.
    known: dict[Any, Value] = field(default_factory=dict)
    #: Sort keys in force: (column name, descending); an aggregate that keeps order sorts by them.
    order: tuple[tuple[str, bool], ...] = ()
    #: The node whose ids the first hop brings along, if the rows are no table yet.
    virtual: str | None = None
    #: The column that says how many equal rows a row stands for, once a pattern has gathered them.
    weight: str | None = None
    #: Pattern variables whose nodes still tell rows apart, and pairs of which the first fixes the second (an owner of a foreign key and its other end).
    held: tuple[str, ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()
    #: Output of a RETURN: (name, column or binding).
    output: tuple | None = None

    def with_df(self, df: DataFrame, **more: Any) -> Rows:
        return replace(self, df=df, **more)

    def start(self, spark) -> DataFrame:
        return spark.range(1).select() if self.df is None else self.df
