"""An inverted-file index of vectors: approximate nearest neighbours by cosine.

Centroids are fitted by k-means on the unit vectors of a bounded sample (``SAMPLE`` rows with the smallest hashes of
their ids; there are about ``sqrt(rows)`` of them, ``MOST_CELLS`` at most).  Every row is then indexed: it is written to
the cell of its nearest centroid, sorted by cell, so that a search reads only the row groups of the cells it probes.
A search probes the cells of the centroids nearest to the query, as many as it took in the sample to hold
``TARGET_RECALL`` of the true neighbours.  A search that finds fewer than k is done over by the exact way.  An index is a table in the shared folder and a small
matrix on the driver; catalogs keep the ones that were built until their nodes change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import has_rows, written

SAMPLE = 20_000
MOST_CELLS = 4096
STEPS = 8
#: Blocks that vectors are dealt into where many queries are asked, and vectors or queries that one holds: more blocks only for very large tables.
BLOCKS, MOST_IN_BLOCK = 12, 100_000
#: Digits of a score that count in a search for many queries.
DIGITS = 12
#: Recall that the share of probed cells is fitted for, on ``ASKED`` rows of the sample and their ``NEAREST`` nearest in it.
TARGET_RECALL, ASKED, NEAREST = 0.95, 500, 10


def _kmeans(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centroids; an empty one stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(STEPS):
        own = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _probes_for(x: np.ndarray, centres: np.ndarray) -> int:
    """Cells to probe: the place of a true neighbour's cell in the order of a query, at the target recall's quantile."""
    asked = x[:ASKED]
    own = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(NEAREST, len(x) - 1)
    if k < 1:
        return len(centres)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return int(np.quantile(np.take_along_axis(place, own[near], 1), TARGET_RECALL, method="higher")) + 1


def taker(k: int, digits: int | None):
    """A function for workers: the k best of each row of a matrix of scores, as (row, column, score) arrays.

    The columns' ids ascend, so that of equal scores the first has the smallest; a row's own id is left out.
    """

    def take(score: np.ndarray, own: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if digits is not None:
            score = np.rint(score * 10.0**digits) / 10.0**digits
        first, last = (np.searchsorted(ids, own, side=s) for s in ("left", "right"))
        for i in np.flatnonzero(last > first):
            score[i, first[i] : last[i]] = -np.inf
        rows = np.arange(len(own))
        for _ in range(min(k, len(ids))):
            top = score.argmax(1)
            value = score[rows, top]
            there = value > -np.inf
            yield rows[there], top[there], value[there]
            score[rows, top] = -np.inf

    return take


class VectorIndex:
    """``build`` it over (id, vec), then ``search`` for one vector or ``search_each`` for many."""

    def __init__(self, items: DataFrame, centres: np.ndarray, probes: int):
        self.items, self.centres, self.probes = items, centres, probes

    @classmethod
    def build(cls, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex | None:
        """The index of the valid vectors of the commonest length; None if there are none."""
        kept = rows.where(vectors.is_valid(F.col("vec"))).select("id", F.col("vec").cast("array<double>").alias("vec"))
        top = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
        if top is None:
            return None
        kept = kept.where(F.size("vec") == top["n"])
        unit = kept.select("id", vectors.normalized(F.col("vec")).alias("unit"))
        share = min(1.0, 2 * sample / top["count"])  # few rows go to the driver, however many there are
        some = unit.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").collect()
        x = np.array([r[0] for r in some], dtype=np.float64)
        if not len(x):
            return None
        centres = _kmeans(x, min(len(x), cells or max(1, min(MOST_CELLS, round(math.sqrt(top["count"]))))))
        sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors
        kind = unit.schema["id"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v @ sent.value.T).argmax(1).astype(np.int32))], names=["id", "unit", "cell"])

        placed = unit.mapInArrow(place, f"id {kind}, unit array<double>, cell int")
        return cls(written(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell"), "cells"), centres, _probes_for(x, centres))

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """``id, score`` of the k nearest, best first."""
        q = np.array(query, dtype=np.float64)
        norm = np.sqrt(q @ q)
        if len(q) != self.centres.shape[1] or not norm > 0:
            return self.items.select("id", F.lit(0.0).alias("score")).limit(0)
        near = np.argsort(-(self.centres @ (q / norm)), kind="stable")[: probes or self.probes]
        score = vectors.dot(F.col("unit"), F.array(*[F.lit(float(x)) for x in q / norm])).alias("score")
        best = lambda rows: rows.select("id", score).orderBy(F.col("score").desc(), "id").limit(k)
        found = best(self.items.where(F.col("cell").isin([int(c) for c in near])))
        return found if len(near) == len(self.centres) or found.count() == k else best(self.items)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cell the first of its blocks and their number: small cells in turn share one, a large one has several."""
        sizes = np.zeros(len(self.centres), dtype=np.int64)
        for cell, count in self.items.groupBy("cell").count().collect():  # at most MOST_CELLS rows
            sizes[cell] = count
        most = min(MOST_IN_BLOCK, max(1, -(-int(sizes.sum()) // BLOCKS)))
        first, parts = np.zeros(len(sizes), dtype=np.int32), np.maximum(1, -(-sizes // most)).astype(np.int32)
        block = held = 0
        for cell, size in enumerate(sizes):
            if held and held + size > most:
                block, held = block + 1, 0
            first[cell] = block
            block, held = (block, held + size) if parts[cell] == 1 else (block + parts[cell], 0)
        return first, parts

    def search_each(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``q, id, score, rk`` for each of ``queries`` (q, vec), the query's own id left out.

        A query is sent once to each block of cells in which it probes some, and a block's cells are compared with the
        queries that probe them in matrix products that keep k rows of each query: what is shuffled does not grow with
        the number of probes.  Scores count to ``DIGITS`` digits, so that equal vectors tie.
        """
        spark, kind = queries.sparkSession, self.items.schema["id"].dataType.simpleString()
        asked = queries.where(vectors.is_valid(F.col("vec")) & F.col("q").isNotNull()).select(F.col("q").cast(kind).alias("q"), vectors.normalized(F.col("vec").cast("array<double>")).alias("qunit"))
        asked = asked.where(F.size("qunit") == self.centres.shape[1])
        n = min(probes or self.probes, len(self.centres))
        first, parts = self.blocks()
        sent = spark.sparkContext.broadcast((self.centres, first, parts))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, first, parts = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    v = np.asarray(some.column(1).flatten(), dtype=np.float64).reshape(some.num_rows, -1)
                    cell = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32).ravel()
                    row = np.repeat(np.arange(some.num_rows), n)
                    times = parts[cell]
                    row, cell, turn = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    block = first[cell] + turn
                    order = np.lexsort((cell, block, row))
                    row, cell, block = row[order], cell[order], block[order]
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, dtype=np.int64)
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(cell.astype(np.int32)))
                    mine = some.take(pa.array(row[starts]))
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(block[starts].astype(np.int32)), cells], names=["q", "qunit", "block", "cells"])

        take = taker(k, DIGITS)

        def best(known: pa.Table, asked: pa.Table) -> pa.Table:
            matrix = lambda c: np.asarray(c.combine_chunks().flatten(), dtype=np.float64).reshape(len(c), -1)
            ids, qids = known.column("id").to_numpy(), asked.column("q").to_numpy()
            found = []
            if len(ids) and len(qids):
                units, qunits = matrix(known.column("unit")), matrix(asked.column("qunit"))
                by_id = np.argsort(ids, kind="stable")
                by_cell = by_id[np.argsort(known.column("cell").to_numpy()[by_id], kind="stable")]
                there, starts = np.unique(known.column("cell").to_numpy()[by_cell], return_index=True)
                lists = asked.column("cells").combine_chunks()
                lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
                row, cell = np.repeat(np.arange(len(qids)), lengths), np.asarray(lists.flatten())
                place = np.empty(len(ids), dtype=np.int64)
                place[by_id] = np.arange(len(ids))
                for at in range(0, len(qids), 4096):
                    here = (row >= at) & (row < at + 4096)
                    mine, of = row[here], cell[here]
                    order = np.argsort(of, kind="stable")
                    mine, of = mine[order], of[order]
                    met = []
                    for i, c in enumerate(there):
                        items = by_cell[starts[i] : starts[i + 1] if i + 1 < len(starts) else None]
                        probing = mine[np.searchsorted(of, c, side="left") : np.searchsorted(of, c, side="right")]
                        step = max(1, 4_000_000 // len(items))
                        for b in range(0, len(probing), step):
                            some = probing[b : b + step]
                            for a, b_, value in take(qunits[some] @ units[items].T, qids[some], ids[items]):
                                met.append((some[a], items[b_], value))
                    if met:
                        q, item, value = (np.concatenate(c) for c in zip(*met, strict=True))
                        order = np.lexsort((place[item], -value, q))
                        q, item, value = q[order], item[order], value[order]
                        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                        found.append((qids[q[rank < k]], ids[item[rank < k]], value[rank < k]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [qids[:0], ids[:0], np.zeros(0)]
            return pa.table({"q": pa.array(cols[0], asked.schema.field("q").type), "id": pa.array(cols[1], known.schema.field("id").type), "score": cols[2]})

        probed = asked.mapInArrow(probe, f"q {kind}, qunit array<double>, block int, cells array<int>")
        # a block meets so many queries at a time that they fit in memory
        turns = max(1, -(-asked.count() // MOST_IN_BLOCK))
        turn = F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int")
        places = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(first))], "cell int, first int, parts int"))
        known = self.items.where("id is not null").join(places, "cell").select("id", "unit", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        met = known.groupBy("block", "turn").cogroup(probed.withColumn("turn", turn).groupBy("block", "turn")).applyInArrow(best, f"q {kind}, id {kind}, score double")
        rank = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id"))
        top = written(met.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k), "nearest")
        short = asked.join(top.groupBy("q").count().where(F.col("count") >= k), "q", "left_anti")
        if not has_rows(short):
            return top
        from .knn import nearest_to_each

        exact = nearest_to_each(self.items.select("id", F.col("unit").alias("vec")), short.select("q", F.col("qunit").alias("vec")), k)
        return top.join(short.select("q"), "q", "left_anti").unionByName(exact)
