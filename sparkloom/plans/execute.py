"""Runs statements: each clause turns the rows into the next rows; changes replace the catalog at once."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CypherTypeError
from ..functions.expressions import Compiler
from ..operators import knn, write
from ..operators.match import Matcher
from ..operators.project import project, result, sort
from ..operators.rows import Rows, Scalar, col, new_slot, shaped
from ..sources.catalog import Catalog
from . import ast as A
from .usage import absent_variable, conditions_on_nodes, counted_uses, needed_in_full, only_endpoints_matter, repeated_kernels


def execute(statement: A.Statement, catalog: Catalog, params: dict[str, Any]) -> tuple[Catalog, DataFrame | None]:
    """The catalog after a statement and, if it ends in a RETURN, the result."""
    clauses = statement.clauses
    full = needed_in_full(clauses)
    rows = Rows()
    skip_to = -1
    for i, clause in enumerate(clauses):
        match clause:
            case A.Match(paths, optional):
                matcher = Matcher(catalog, params, full, only_endpoints_matter(clauses, i), {} if optional else conditions_on_nodes(clauses, i), None if optional else counted_uses(clauses, i))
                absent = absent_variable(clauses, i) if optional and rows.df is not None else None
                if absent and absent[0] not in rows.scope and any(absent[0] == n.var for p in paths for n in p.nodes):
                    rows, skip_to = matcher.absent(rows, paths), absent[1]
                else:
                    rows = matcher.optional(rows, paths) if optional else matcher.match(rows, paths)
            case A.Where(condition):
                if i != skip_to:
                    df, known = rows.start(catalog.spark), dict(rows.known)
                    for e in repeated_kernels(clauses, i):  # computed once, before the filter
                        v = Compiler(rows.scope, params)(e)
                        if e not in known and v.type != "null":
                            slot = new_slot("v")
                            df = df.withColumn(slot, v.col)
                            known[e] = shaped(col(slot), v)
                    for c in Compiler(rows.scope, params, {**rows.sortable, **known}).condition(condition):
                        df = df.where(c)
                    rows = rows.with_df(df, known=known)
            case A.Project():
                following = clauses[i + 1] if i + 1 < len(clauses) else None
                rows = project(rows, clause, params, following.keys if isinstance(following, A.OrderBy) else (), catalog.spark)
            case A.OrderBy(keys):
                rows = sort(rows, keys, params)
            case A.Skip(count):
                if (n := _count(count, params, "SKIP")) > 0:
                    rows = rows.with_df(rows.df.offset(n))
            case A.Limit(count):
                if (n := _count(count, params, "LIMIT")) >= 0:
                    rows = rows.with_df(rows.df.limit(n))
            case A.Unwind(e, var):
                rows = unwind(rows, e, var, params, catalog)
            case A.CallProcedure():
                rows = knn.call(catalog, rows, clause, params)
            case A.Create(paths):
                catalog, rows = write.create(catalog, rows, paths, params)
            case A.Merge():
                catalog, rows = write.merge(catalog, rows, clause, params)
            case A.SetProps(items):
                catalog, rows = write.set_properties(catalog, rows, items, params)
            case A.RemoveProps(items):
                catalog, rows = write.remove_properties(catalog, rows, items)
            case A.Delete(targets, detach):
                catalog, rows = write.delete(catalog, rows, targets, detach)
            case _:
                raise CypherTypeError(f"cannot run {clause!r}")
    return catalog, result(rows) if rows.output is not None else None


def _count(e: Any, params: dict[str, Any], what: str) -> int:
    n = e.value if isinstance(e, A.Literal) else params.get(e.name)
    if not isinstance(n, int) or isinstance(n, bool):
        raise CypherTypeError(f"{what} needs a whole number")
    return n


def unwind(rows: Rows, e: Any, var: str, params: dict[str, Any], catalog: Catalog) -> Rows:
    """A row for each element of a list (none if it is empty), or one row with a value that is no list."""
    v = Compiler(rows.scope, params, rows.sortable)(e)
    slot = new_slot("u")
    df = rows.start(catalog.spark)
    if v.type == "list":
        items = F.when(v.col.isNull(), F.array_repeat(F.get(v.col, 0), 1)).otherwise(v.col)
        df = df.withColumn(slot, F.explode(items))
        item = v.item
        scalar = Scalar(slot, item.type if item else "null", item.item if item else None, item.fields if item else None)
    else:
        if v.entity:
            return replace(rows, scope={**rows.scope, var: v.entity}, sortable={}, output=None)
        df = df.withColumn(slot, F.lit(None).cast("string") if v.type == "null" else v.col)
        scalar = Scalar(slot, v.type, v.item, v.fields)
    return Rows(df, {**rows.scope, var: scalar})


__all__ = ["execute", "unwind"]
