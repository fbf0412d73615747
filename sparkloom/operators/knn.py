"""Nearest neighbours: exact top-k, the same through an index, and many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CypherTypeError
from ..functions import values as V
from ..functions import vectors
from ..functions.expressions import Compiler, constant_norm
from ..plans import ast as A
from ..sources.catalog import Catalog, merged
from .ivf import BLOCKS, MOST_IN_BLOCK, VectorIndex, taker
from .match import Matcher
from .rows import Rows, Scalar, new_slot

#: Procedures by lower-case name.  Others may be added.
PROCEDURES: dict[str, Callable[..., Rows]] = {}
#: Query vectors that `nearest_to_each` sends to all tasks, and pairs that it makes rows of.
MOST_QUERIES, MOST_PAIRS = 1000, 1_000_000


def call(catalog: Catalog, rows: Rows, clause: A.CallProcedure, params: dict[str, Any]) -> Rows:
    if clause.name.lower() not in PROCEDURES:
        raise CypherTypeError(f"unknown procedure {clause.name}")
    found = PROCEDURES[clause.name.lower()](catalog, [Compiler({}, params)(e) for e in clause.args])
    scope = {}
    for name, alias in clause.yields or [(n, n) for n in found.scope]:
        if name not in found.scope:
            raise CypherTypeError(f"{clause.name} yields no `{name}`")
        scope[alias] = found.scope[name]
    if rows.df is None:
        return Rows(found.df, scope, order=found.order)
    return Rows(rows.df.crossJoin(found.df), {**rows.scope, **scope})


def _nearest(catalog: Catalog, args: list[V.Value]) -> Rows:
    """``vector.nearest(field, query [, k])``: the k nodes whose vectors are nearest to the query by cosine.

    The name of the field must be a string; a node has one vector, whatever its name.
    """
    if not 2 <= len(args) <= 3 or args[0].type != "string" or args[1].type != "list":
        raise CypherTypeError("vector.nearest takes a field name, a vector and optionally k")
    k = args[2].literal if len(args) == 3 else 10
    if not isinstance(k, int) or isinstance(k, bool) or k < 0:
        raise CypherTypeError("k must be a whole number of 0 or more")
    tables = [t for t in catalog.node_tables() if t.has_vectors]
    df, node = Matcher(catalog, {}, set()).scan(None, (), (), tables)
    slot = new_slot("s")
    if not tables:
        df = df.withColumn(slot, F.lit(None).cast("double"))
    else:
        query = F.array(*[F.lit(float(x)) for x in args[1].literal]) if args[1].literal else args[1].col
        df = df.withColumn(slot, vectors.cosine(node.vector, query, norm_b=constant_norm(args[1])))
    top = df.where(F.col(slot).isNotNull()).orderBy(F.col(slot).desc(), node.id).limit(k)
    return Rows(top, {"node": node, "score": Scalar(slot, "float")}, order=((slot, True),))


PROCEDURES["vector.nearest"] = _nearest


def index_of(catalog: Catalog) -> VectorIndex | None:
    """The index over the vectors of all nodes: built once, and again only after their tables have changed."""
    tables = [t for t in catalog.node_tables() if t.has_vectors]
    held = catalog.indexes.get("vectors")
    if held is None or [id(df) for df in held[0]] != [id(t.df) for t in tables]:
        rows = [t.df.select(F.col("_id").alias("id"), F.col("_vec").cast("array<double>").alias("vec")) for t in tables]
        held = catalog.indexes["vectors"] = ([t.df for t in tables], VectorIndex.build(merged(rows)) if rows else None)
    return held[1]


def _approximate(catalog: Catalog, args: list[V.Value]) -> Rows:
    """``vector.approximate(field, query [, k])``: as ``vector.nearest``, through the index."""
    if not 2 <= len(args) <= 3 or args[0].type != "string" or args[1].literal is None:
        raise CypherTypeError("vector.approximate takes a field name, a constant vector and optionally k")
    k = args[2].literal if len(args) == 3 else 10
    if not isinstance(k, int) or isinstance(k, bool) or k < 0:
        raise CypherTypeError("k must be a whole number of 0 or more")
    index = index_of(catalog)
    if index is None:
        return _nearest(catalog, args)
    df, node = Matcher(catalog, {}, set()).scan(None, (), (), [t for t in catalog.node_tables() if t.has_vectors])
    slot = new_slot("s")
    found = index.search([float(x) for x in args[1].literal], k).select(F.col("id").alias(f"{slot}__id"), F.col("score").alias(slot))
    df = df.join(found, node.id == F.col(f"{slot}__id")).drop(f"{slot}__id").orderBy(F.col(slot).desc(), node.id)
    return Rows(df, {"node": node, "score": Scalar(slot, "float")}, order=((slot, True),))


PROCEDURES["vector.approximate"] = _approximate


def nearest_to_each(vectors_df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """The k nearest of ``vectors_df`` (id, vec) for each of ``queries`` (q, vec), the query's own id left out: ``q, id, score, rk``.

    Ties go to the smaller id.  Queries are sent to the vectors only up to ``MOST_QUERIES`` and ``MOST_PAIRS``; more go
    the way of ``nearest_of_all``, so that neither what is sent nor what is sorted grows with the data.
    """
    count = queries.limit(MOST_QUERIES + 1).count()
    if count > MOST_QUERIES or count * vectors_df.count() > MOST_PAIRS:
        return nearest_of_all(vectors_df, k, digits, queries, metric)
    asked = queries.select("q", F.col("vec").alias("qvec"))
    known = vectors_df.select("id", "vec")
    if metric == "cosine":  # norms are computed once for each vector, before pairs are made
        asked, known = asked.withColumn("qnorm", vectors.norm(F.col("qvec"))), known.withColumn("norm", vectors.norm(F.col("vec")))
        score = vectors.cosine(F.col("vec"), F.col("qvec"), F.col("norm"), F.col("qnorm"))
    else:
        score = vectors.similarity(metric, F.col("vec"), F.col("qvec"))
    scored = known.join(F.broadcast(asked), F.col("q") != F.col("id"))
    scored = scored.select("q", "id", (F.round(score, digits) if digits is not None else score).alias("score")).where("score is not null")
    return _ranked(scored, k)  # the k best are kept per partition first


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)


def nearest_of_all(vectors_df: DataFrame, k: int, digits: int | None = 6, queries: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """The k nearest of ``vectors_df`` (id, vec) for each of ``queries`` (q, vec), or of every vector, its own id left out: ``q, id, score, rk``.

    Exact: each pair of a block of queries and one of vectors is one matrix product in a Python worker, which keeps the
    k best of each row.  There are as many blocks of queries as must be, as each vector is sent to all of them.  Scores
    are rounded to ``digits`` before they are ranked and ties go to the smaller id, as in ``nearest_to_each``.  Vectors
    of different lengths do not meet; those that are null, empty or not finite are left out.
    """
    import numpy as np
    import pyarrow as pa

    def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "euclidean":
            square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            return 1 / (1 + np.sqrt(np.maximum(square, 0)))
        return a @ b.T

    take = taker(k, digits)

    def best(part: pa.Table) -> pa.Table:
        ids, side = part.column("id").to_numpy(), part.column("side").to_numpy()
        rows = np.asarray(part.column("vec").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        if metric == "cosine":
            rows = rows / np.maximum(np.sqrt((rows * rows).sum(1)), np.finfo(float).tiny)[:, None]
        asked, known = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        known = known[np.argsort(ids[known], kind="stable")]  # of equal scores the first has the smallest id
        out = []
        step = max(1, 4_000_000 // max(1, len(known)))
        for at in range(0, len(asked), step) if len(known) else []:
            mine = asked[at : at + step]
            for a, b, value in take(similarity(rows[mine], rows[known]), ids[mine], ids[known]):
                out.append((ids[mine[a]], ids[known[b]], value))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [ids[:0], ids[:0], np.zeros(0)]
        kind = part.schema.field("id").type
        return pa.table({"q": pa.array(cols[0], kind), "id": pa.array(cols[1], kind), "score": cols[2]})

    if metric not in vectors.METRICS:
        raise CypherTypeError(f"metric {metric!r} is none of {', '.join(vectors.METRICS)}")
    # single precision is sent as it is and computed with in double precision
    single = all(df.schema["vec"].dataType.simpleString() == "array<float>" for df in (vectors_df, queries) if df is not None)
    valid = lambda df, key: df.where(vectors.is_valid(F.col("vec")) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col("vec").cast("array<float>" if single else "array<double>").alias("vec"))
    kept = valid(vectors_df, "id")
    asked = kept if queries is None else valid(queries, "q")
    kind = kept.schema["id"].dataType.simpleString()
    known = kept.count()
    blocks, turns = max(BLOCKS, -(-known // MOST_IN_BLOCK)), max(1, -(-(known if queries is None else asked.count()) // MOST_IN_BLOCK))
    dealt = lambda df, mine, n, other, m, side: df.select("id", "vec", F.size("vec").alias("size"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(side).alias("side"))
    met = dealt(asked, "a", turns, "b", blocks, 0).unionByName(dealt(kept, "b", blocks, "a", turns, 1))
    return _ranked(met.groupBy("size", "a", "b").applyInArrow(best, f"q {kind}, id {kind}, score double"), k)
