"""Near-duplicate embeddings by the epsilon grid order join.

Vectors of equal, non-null label are linked if their cosine in double precision is at least ``threshold``.  On unit
vectors that is a Euclidean distance of at most epsilon = sqrt(2 - 2 * threshold).

1. Equal vectors of a label form a class (told apart by a digest of 128 bits).
2. Principal axes are found from sums of d x d numbers over all rows.  Unit vectors are sorted, within their label, in
   epsilon grid order: lexicographically by their cells of width epsilon on the leading ``dims`` axes.  The sorted
   sequence is cut into blocks of about ``block`` vectors.
3. The sequence interval join: two blocks of a label can only hold a link if their intervals of cells are at most one
   apart on the first axis and on the second, so blocks meet by an equi-join on (label, cell, cell); pairs of blocks
   whose bounding boxes over all axes are farther apart than epsilon are skipped.  A surviving pair is joined
   recursively: both intervals are halved, halves whose boxes are provably distant are skipped, and small ones are
   compared by a matrix product in double precision.  Axes decide what is skipped; links are decided on the vectors
   as they are.
4. No pair leaves a task: it gives each class its number of links and its root in the task's forest; components are
   found from these edges.

How much is skipped depends on the data.  Vectors that spread evenly over very many axes fill all cells of the leading
ones, and then most blocks of a label meet: the work is quadratic in the label's size, at block x block pairs a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows of null label, link
with nothing and are their own component; vectors of different lengths never link; rows that repeat a vec_id count
one by one; a null vec_id is kept (its component is named by the smallest id there is); an empty table gives no rows;
of pairs that tie with the threshold all are links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, components, discard, forest, has_rows, prepare, runs, written

THRESHOLD = 0.98
DIMS = 6
BLOCK = 4096
LEAF = 64


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, label, d, unit``: unit is null where a vector links with nothing."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, units = [], [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                unit = None
                if label is not None and v and None not in v:
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    if top > 0:
                        x = x / top  # no overflow or underflow in the norm
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
                dims.append(len(v) if unit else 0)
                keys.append(xxhash.xxh3_128_digest(f"{label}:".encode() + np.array(v, dtype=np.float64).tobytes()) if unit else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "key", "label", "d", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(build, "vec_id long, key binary, label long, d int, unit binary")


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of the unit vectors of each dimension: from sums of d + d x d numbers per task."""

    def rows(total: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tobytes() for _, s in total.values()], pa.binary())], names=["d", "n", "sums"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            d = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            for k in np.unique(d).tolist():
                x = np.frombuffer(b"".join(raw[i] for i in np.flatnonzero(d == k)), dtype=np.float64).reshape(-1, k)
                n, s = total.get(k, (0, 0.0))
                total[k] = (n + len(x), s + np.concatenate([x.sum(0), (x.T @ x).ravel()]))
        yield from rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, s = total.get(r["d"], (0, 0.0))
                total[r["d"]] = (n + r["n"], s + np.frombuffer(r["sums"], dtype=np.float64))
        yield from rows(total)

    kind = "d int, n long, sums binary"
    few = classes.select("d", "unit").mapInArrow(sums, kind).repartition(16).mapInArrow(add, kind)  # the driver gets 16 rows a dimension at most
    parts: dict[int, tuple[int, np.ndarray]] = {}
    for r in few.collect():
        n, s = parts.get(r["d"], (0, 0.0))
        parts[r["d"]] = (n + r["n"], s + np.frombuffer(r["sums"], dtype=np.float64))
    out = {}
    for d, (n, s) in parts.items():
        mean, second = s[:d] / n, s[d:].reshape(d, d) / n
        _, vectors = np.linalg.eigh(second - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _in_grid_order(classes: DataFrame, axes: Broadcast, eps: float, dims: int) -> DataFrame:
    """Classes with ``cells``, a binary that sorts in epsilon grid order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(batch.schema.get_field_index("d")).to_numpy()
            raw = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            cells: list[bytes] = [b""] * len(raw)
            for k in np.unique(d).tolist():
                at = np.flatnonzero(d == k)
                x = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.float64).reshape(-1, k) @ axes.value[k][:, :dims]
                grid = (np.floor(x / eps).astype(np.int64) + (1 << 31)).astype(">u4")
                for row, i in enumerate(at.tolist()):
                    cells[i] = grid[row].tobytes()
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "label", "d", "weight", "unit")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(cells, pa.binary())], names=["key", "label", "d", "weight", "unit", "cells"])

    return classes.mapInArrow(place, "key binary, label long, d int, weight long, unit binary, cells binary")


def _cell(cells: bytes, axis: int) -> int:
    return int.from_bytes(cells[4 * axis : 4 * axis + 4], "big") - (1 << 31)


def _blocks(ordered: DataFrame, axes: Broadcast, block: int) -> DataFrame:
    """One row per block: ``label, d, block``, its cells on two axes (``low1``...), box, and its vectors as one matrix.

    The order is global (range partitioning by label, dimension and cells), so a label of any size is spread over
    tasks; each task cuts its part of the sequence.
    """
    spread = ordered.repartitionByRange("label", "d", "cells", "key").sortWithinPartitions("label", "d", "cells", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def row() -> pa.RecordBatch:
            d = held[0]["d"]
            x = np.frombuffer(b"".join(r["unit"] for r in held), dtype=np.float64).reshape(-1, d)
            turned = x @ axes.value[d]
            second = [_cell(r["cells"], 1) for r in held] if len(held[0]["cells"]) > 4 else [0]
            values = {
                "label": held[0]["label"], "d": d, "block": xxhash.xxh3_64_intdigest(b"".join(r["key"] for r in held)) >> 1,
                "low1": _cell(held[0]["cells"], 0), "high1": _cell(held[-1]["cells"], 0), "low2": min(second), "high2": max(second), "box": _box(turned).tobytes(),
                "keys": b"".join(r["key"] for r in held), "weights": np.array([r["weight"] for r in held], dtype=np.int64).tobytes(), "x": x.tobytes(),
            }
            return pa.RecordBatch.from_pylist([values], schema=_BLOCK_ROWS)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= block or r["label"] != held[0]["label"] or r["d"] != held[0]["d"] or _cell(r["cells"], 0) > _cell(held[0]["cells"], 0) + MOST_CELLS):
                    yield row()
                    held.clear()
                held.append(r)
        if held:
            yield row()

    return spread.mapInArrow(cut, "label long, d int, block long, low1 long, high1 long, low2 long, high2 long, box binary, keys binary, weights binary, x binary")


#: First-axis cells that a block may span, so that it meets its neighbours in few cells.
MOST_CELLS = 8
_BLOCK_ROWS = pa.schema([("label", pa.int64()), ("d", pa.int32()), *((c, pa.int64()) for c in ("block", "low1", "high1", "low2", "high2")), *((c, pa.binary()) for c in ("box", "keys", "weights", "x"))])


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two boxes, each (2, d): lower and upper bounds."""
    gap = np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0)
    return float(np.sqrt(gap @ gap))


def _box(x: np.ndarray) -> np.ndarray:
    return np.stack([x.min(0), x.max(0)])


def ego_join(left: np.ndarray, right: np.ndarray, axes: np.ndarray, eps: float, threshold: float, same: bool, leaf: int = LEAF, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) of unit vectors at the threshold, by recursion over sequence intervals; i < j if ``same``.

    Boxes along the ``axes`` tell what can be skipped.  Pairs come in parts of about ``most``.
    """
    turned = [left @ axes, right @ axes]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(0, len(left), 0, len(right))]
    slack = eps * (1 + 1e-9) + 1e-12
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a or a >= b or c >= d:
            continue
        if not (same and a == c) and _apart(_box(turned[0][a:b]), _box(turned[1][c:d])) > slack:
            continue
        if b - a <= leaf and d - c <= leaf:
            i, j = np.nonzero(left[a:b] @ right[c:d].T >= threshold)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            held += len(i)
            if held >= most:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
                found, held = [], 0
            continue
        if same and a == c:  # halves of one interval: three of its four pairs
            m = (a + b) // 2
            stack += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Ids of pairs of blocks that may hold links: ``p, q`` with p <= q."""
    thin = blocks.select("label", "d", "block", "low1", "high1", "low2", "high2", "box")
    met_in = lambda more: thin.withColumn("cell1", F.explode(F.sequence(F.col("low1") - more, F.col("high1") + more))).withColumn("cell2", F.explode(F.sequence(F.col("low2") - more, F.col("high2") + more)))
    mine, near = met_in(0).select("label", "d", "block", "box", "cell1", "cell2"), met_in(1).select("label", "d", "cell1", "cell2", F.col("block").alias("block_q"), F.col("box").alias("box_q"))
    met = mine.join(near, ["label", "d", "cell1", "cell2"]).where("block <= block_q").select("block", "block_q", "box", "box_q")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(k).to_pylist() for k in (2, 3))  # boxes
            keep = [i for i in range(len(p)) if _apart(np.frombuffer(p[i]).reshape(2, -1), np.frombuffer(q[i]).reshape(2, -1)) <= eps * (1 + 1e-9) + 1e-12]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["p", "q"])

    return met.mapInArrow(close, "p long, q long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, path = written(_unit_vectors(vectors), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("d").alias("d"), F.any_value("unit").alias("unit"))
    classes, classes_path = written(classes, "classes")
    if not has_rows(classes):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = spark.sparkContext.broadcast(_axes(classes))  # d x d numbers per dimension
    blocks, blocks_path = written(_blocks(_in_grid_order(classes, axes, eps, dims), axes, block), "blocks")
    pairs = _block_pairs(blocks, eps)
    # a pair of blocks is dealt as two rows, one per block, not joined: each row holds one block
    ends = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    meeting = ends.join(blocks.select("block", "d", "keys", "weights", "x"), "block").repartition("p", "q").sortWithinPartitions("p", "q", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["p", "q"]):
            r = group.to_pylist()
            x = [np.frombuffer(v["x"]).reshape(-1, v["d"]) for v in r]
            w = [np.frombuffer(v["weights"], dtype=np.int64) for v in r]
            keys = [v["keys"][k : k + 16] for v in r for k in range(0, len(v["keys"]), 16)]
            weight, links, root = np.concatenate(w), np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
            for i, j in ego_join(x[0], x[-1], axes.value[r[0]["d"]], eps, threshold, len(r) == 1):
                j = j + (len(x[0]) if len(r) == 2 else 0)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = forest(len(keys), root[i], root[j])[root]
            some = np.flatnonzero(links)
            if not len(some):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([keys[k] for k in root[some]], pa.binary())], names=["key", "links", "root"])

    found, found_path = written(meeting.mapInArrow(compare, "key binary, links long, root binary"), "links")
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = classes.select("key", "rep", "weight").join(linked, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    info = attach(info, ["root"], F.col("key"), {"component_id": F.min("rep")}, {"component_id": F.min("component_id")})
    info, _ = written(info.select("key", "weight", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "info")
    discard(spark, classes_path, blocks_path, found_path)
    # a class's row is sent to the salts in which it has vectors
    dealt = rows.select("vec_id", "key").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(48)).cast("int"))
    salts = dealt.where("key is not null").select("key", "salt").distinct().groupBy("key").agg(F.collect_list("salt").alias("salts"))
    values = info.join(salts, "key").withColumn("salt", F.explode("salts")).drop("salts")
    out = dealt.join(values, ["key", "salt"], "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

