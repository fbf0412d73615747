"""Mixing of sources to target weights through a multivariate-hypergeometric splitting tree.

Each source has a target number of words.  A source whose target is k times its size and a remainder r gives k
whole passes and one partial pass.  Its documents are dealt into blocks by hash, and the blocks are permuted by a
second hash.  A source's quota is its exact number of blocks in all passes: k times all of them, and of the partial
pass as many as r words are worth.

The splitting tree deals all quotas out to the output shards: the vector of quotas of a range of shards is split
between its two halves by a multivariate hypergeometric draw of the left half's exact number of blocks, and so on
down to single shards.  Every shard thus has a run of each source's permuted blocks, disjoint from other shards' runs:
in a whole pass it takes them all; its share of the partial pass is drawn from the candidates that its run stands for
(the source's blocks in proportion), block by block until the run's share of r words is reached.  The shares add up to
r exactly, so the source meets its target; the tree decides which blocks, hence which documents, are taken.  A block
that would overshoot is entered document by document, and the document at the boundary gives only the words still
wanted (or, with ``whole=True``, is taken or left, whichever is nearer).  Each shard then shuffles its documents
locally: by a hash, in ranges of it that are counted first, so that no task sorts a whole shard.
``mixed_documents`` are sorted by shard and position.

The driver holds one row per source and the top of the tree (``MOST_CELLS`` quotas at most); tasks expand the subtrees,
each node drawing from a generator of its own.  Blocks find their shard by an equi-join on source and rank.  Ranks of
blocks are found in two steps (``BINS`` ranges of the hash, then within a range), so that a source with a third of all
rows is not sorted in one task.  The numbers of shards and blocks follow the corpus's words.

Defined results: size is the number of runs of characters other than space, tab, LF, VT, FF and CR, 0 for null text;
null is a source of its own, last in order; sources with no words have target 0; very long texts are documents like
others (the target is still met); rows of equal doc_id, source and text are merged with their number before they are
dealt and count one by one, the first of them taken first; rows without doc_id are told apart by their texts; an empty
table gives no rows; other columns, whatever their names, are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import has_rows, prepare, unused_name, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
BLOCK_WORDS = 50_000
#: Blocks grow with corpora of more than this many of them (numpy draws from at most 1e9).
MOST_BLOCKS = 200_000_000
SHARD_WORDS = 2_000_000
BINS = 1024
#: Quotas of sources x subtrees that the driver holds.
MOST_CELLS = 1_000_000
#: Sources that are sent to all executors (about 100 bytes each); more are joined by a shuffle.
FEW_SOURCES = 100_000
#: Rows of equal doc_id, source and text that one task writes out.
RUN = 1000
ENTRY = ("doc_id", "source", "size", "mark")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight; none over ``most`` times its source, the excess reshared by weight among the others."""
    out, total, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        total -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def halves(quotas: np.ndarray, low: int, high: int, seed: int) -> tuple[int, np.ndarray]:
    """The middle of the shards ``low`` to ``high`` (exclusive) and the quotas of those before it: an exact number of blocks in all."""
    middle = (low + high) // 2
    blocks = int(quotas.sum()) * (middle - low) // (high - low)
    rng = np.random.default_rng([seed, low, high])
    return middle, rng.multivariate_hypergeometric(quotas, blocks, method="marginals") if blocks else quotas * 0


def splitting_tree(quotas: np.ndarray, first: np.ndarray, low: int, high: int, seed: int, most: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``low, high, first, quotas`` of the nodes of ``most`` shards or fewer, from left to right.

    ``first`` counts each source's blocks in the shards before a node, so that nodes hold disjoint runs.
    """
    stack = [(low, high, first, quotas)]
    while stack:
        low, high, first, quotas = stack.pop()
        if high - low <= most:
            yield low, high, first, quotas
            continue
        middle, left = halves(quotas, low, high, seed)
        stack += [(middle, high, first + left, quotas - left), (low, middle, first, left)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, mark`` of each document; ``mark`` is a hash of its text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"))


def source_table(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``at, source, source_size, target, blocks, passes, rest, some``: one row per source, made on the driver from its size.

    ``some`` is the number of blocks that the partial pass is worth.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))  # UTF-8 bytes order as code points
    goal = targets([r[1] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    block = max(BLOCK_WORDS, sum(r[1] for r in rows) // MOST_BLOCKS)
    out = []
    for at, (r, t) in enumerate(zip(rows, goal, strict=True)):
        words, size = round(t), r[1]
        blocks = max(1, -(-size // block))
        full = min(words // size, int(most)) if size else 0
        rest = int(words - full * size) if size else 0
        out.append((at, r[0], size, t, blocks, int(full), rest, max(1, blocks * rest // size) if rest else 0))
    return sized.sparkSession.createDataFrame(out, "at int, source string, source_size long, target double, blocks long, passes int, rest long, some long")


def _known(sources: DataFrame, *columns: str) -> DataFrame:
    few = sources.select(*columns)
    return F.broadcast(few) if sources.count() <= FEW_SOURCES else few


def entries(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``sized`` with their source's number ``at`` and ``block``; equal ones are one entry with their number ``rows``."""
    own = _known(sources, F.col("source").alias("named"), "at", "blocks")
    merged = sized.groupBy(*ENTRY).agg(F.count("*").alias("rows"))
    found = merged.join(own, F.col("source").eqNullSafe(F.col("named"))).withColumn("block", F.pmod(_draw(SEED, "doc_id", "size", "mark"), "blocks"))
    return found.select(*ENTRY, "rows", "at", "block")


SEED = 7


def _draw(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _ranked(found: DataFrame, seed: int) -> DataFrame:
    """``at, block, n, rank, before``: each block's words, place in its source's permutation and words before it."""
    blocks = found.groupBy("at", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("n"))
    blocks = blocks.withColumn("key", _draw(seed, "at", "block")).withColumn("bin", F.pmod(F.shiftright("key", 20), F.lit(BINS)))
    earlier = Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = blocks.groupBy("at", "bin").agg(F.sum("n").alias("bin_n"), F.count("*").alias("bin_c"))
    bins = bins.select("at", "bin", F.coalesce(F.sum("bin_n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bin_c").over(earlier), F.lit(0)).alias("c0"))
    within = Window.partitionBy("at", "bin").orderBy("key", "block")
    blocks = blocks.withColumn("n_in", F.sum("n").over(within) - F.col("n")).withColumn("c_in", F.row_number().over(within) - 1)
    return blocks.join(bins, ["at", "bin"]).select("at", "block", "n", (F.col("c0") + F.col("c_in")).alias("rank"), (F.col("n0") + F.col("n_in")).alias("before"))


def _turns(sources: DataFrame, there: dict[int, int], seed: int) -> DataFrame:
    """``at, pass, rank, shard``: the blocks that the tree deals to each shard, candidates of the partial pass among them.

    ``there`` has the number of blocks that hold words, by source.
    """
    spark = sources.sparkSession
    rows = [r for r in sources.orderBy("at").collect() if there.get(r["at"])]
    total = sum(r["target"] for r in rows)
    shards = max(1, round(total / SHARD_WORDS))
    at, blocks = (np.array(x, dtype=np.int64) for x in ([r["at"] for r in rows], [there[r["at"]] for r in rows]))
    passes, some = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("passes", "some"))
    some = np.minimum(some, blocks)
    quotas = passes * blocks + some
    most = -(-shards // max(1, min(256, MOST_CELLS // max(1, len(rows)))))
    nodes = [(low, high, first.tolist(), q.tolist()) for low, high, first, q in splitting_tree(quotas, quotas * 0, 0, shards, seed, most)] if rows else []
    fixed = spark.sparkContext.broadcast((at, blocks, passes, some))  # four numbers per source

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, passes, some = fixed.value
        for node in (x for batch in batches for x in batch.to_pylist()):
            for shard, _, first, quota in splitting_tree(np.array(node["quotas"], dtype=np.int64), np.array(node["first"], dtype=np.int64), node["low"], node["high"], seed):
                out: list[list[np.ndarray]] = [[], [], []]
                for i in np.flatnonzero(quota).tolist():
                    n, whole, a, z = int(blocks[i]), int(passes[i] * blocks[i]), int(first[i]), int(first[i] + quota[i])
                    place = np.arange(a, min(z, whole), dtype=np.int64)
                    turn, rank = place // n, place % n
                    if z > whole:  # the run's candidates in the partial pass
                        extra = np.arange(max(a - whole, 0) * n // int(some[i]), (z - whole) * n // int(some[i]), dtype=np.int64)
                        turn, rank = np.append(turn, np.full(len(extra), passes[i])), np.append(rank, extra)
                    for col, value in zip(out, (np.full(len(rank), at[i]), turn, rank), strict=True):
                        col.append(value)
                if out[0]:
                    source, turn, rank = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays([pa.array(source.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(rank), pa.array(np.full(len(rank), shard, dtype=np.int32))], names=["at", "pass", "rank", "shard"])

    prepare(spark)
    top = spark.createDataFrame(nodes, "low int, high int, first array<long>, quotas array<long>").repartition(max(1, len(nodes)), "low")
    return top.mapInArrow(expand, "at int, pass int, rank long, shard int")


def mix(sized: DataFrame, sources: DataFrame, seed: int = SEED, whole: bool = False) -> DataFrame:
    """``doc_id, source, size, mark, rows, pass, words, taken, shard, position``: each entry once for each pass that takes it.

    An entry stands for ``rows`` equal rows: the mix takes ``words`` of them together, from the first ``taken`` rows, which
    stand at ``position`` and after it.  ``sized`` (of ``measured``) should be written down.
    """
    found, _ = written(entries(sized, sources).where("size > 0"), "entries")
    blocks, _ = written(_ranked(found, seed), "blocks")
    there = dict(blocks.groupBy("at").count().collect())
    own = _known(sources, "at", "passes", "rest", "source_size")
    turns, _ = written(_turns(sources, there, seed).join(blocks, ["at", "rank"]).join(own, "at"), "turns")
    full = turns.where("pass < passes").select("at", "block", "pass", "shard", F.col("n").alias("quota"))
    # a shard's run of the partial pass, in words: its share of the rest
    part = turns.where("pass = passes")
    share = lambda c: f"cast(rest as decimal(19,0)) * {c} div source_size"
    runs = part.groupBy("at", "shard").agg(F.min("before").alias("low"), F.max(F.col("before") + F.col("n")).alias("high"))
    part = part.join(runs, ["at", "shard"]).withColumn("goal", F.expr(f"{share('high')} - {share('low')}"))
    part = part.withColumn("quota", F.least("n", F.col("goal") - (F.col("before") - F.col("low")))).where("quota > 0")
    taken = found.join(full.unionByName(part.select(full.columns)), ["at", "block"]).withColumn("all", F.col("size") * F.col("rows"))
    order = Window.partitionBy("at", "block", "pass").orderBy(_draw(seed, "doc_id", "size", "mark"), "doc_id", "size", "mark")
    left = F.greatest(F.col("quota") - (F.sum("all").over(order) - F.col("all")), F.lit(0))
    taken = taken.withColumn("left", F.least("all", left))
    if whole:
        taken = taken.withColumn("taken", F.expr("(2 * left + size) div (2 * size)")).withColumn("words", F.col("taken") * F.col("size"))
    else:
        taken = taken.withColumn("taken", F.expr("(left + size - 1) div size")).withColumn("words", F.col("left"))
    # the shuffle within a shard, in ranges of the hash (its upper ten bits): a shard is not sorted in one task
    taken = taken.where("taken > 0").withColumn("key", _draw(seed, "doc_id", "pass", "size", "mark")).withColumn("range", F.shiftright("key", 54).cast("int"))
    taken, _ = written(taken.select(*ENTRY, "rows", "pass", "words", "taken", "shard", "key", "range"), "taken")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = taken.groupBy("shard", "range").agg(F.sum("taken").alias("c"))
    ranges = ranges.select("shard", "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    within = Window.partitionBy("shard", "range").orderBy("key", *ENTRY, "pass")
    placed = taken.withColumn("until", F.sum("taken").over(within)).join(ranges, ["shard", "range"])
    return placed.select(*ENTRY, "rows", "pass", "words", "taken", "shard", (F.col("c0") + F.col("until") - F.col("taken") + 1).alias("position"))


def _numbered(found: DataFrame) -> DataFrame:
    """Each entry once for each of its rows, numbered from 1 in ``row``; an entry of very many rows is written out by many tasks."""
    parts = found.withColumn("run", F.explode(F.expr(f"sequence(0L, (rows - 1) div {RUN})")))
    if has_rows(found.where(F.col("rows") > RUN)):
        parts = parts.repartition("mark", "run")
    return parts.withColumn("row", F.explode(F.expr(f"sequence(run * {RUN} + 1, least(rows, (run + 1) * {RUN}))"))).drop("run")


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shard, position`` of each row of ``docs``.

    ``taken`` counts the words that the mix takes of it, repeats included; ``shard`` and ``position`` are arrays, an
    element for each time it is taken.
    """
    sized, _ = written(measured(docs), "sized")
    sources = source_table(sized)
    places = F.array_sort(F.collect_list(F.struct("pass", "words", "taken", "shard", "position")))  # one for each pass
    key = F.struct(*ENTRY)  # nulls are equal within a struct
    placed = mix(sized, sources, seed).groupBy(key.alias("placed")).agg(places.alias("places"))
    found = entries(sized, sources).withColumn("entry", key)
    found, _ = written(found.join(placed, F.col("entry") == F.col("placed"), "left").select("doc_id", "size", "mark", "rows", "at", "places"), "places")
    rows = _numbered(found).withColumn("places", F.filter(F.coalesce("places", F.array().cast(found.schema["places"].dataType)), lambda p: p["taken"] >= F.col("row")))
    words = lambda p: F.least(F.col("size"), p["words"] - (F.col("row") - 1) * F.col("size"))
    rows = rows.join(_known(sources, "at", "source_size", "target"), "at")
    return rows.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + words(p)).alias("taken"),
        F.col("places.shard").alias("shard"), F.transform("places", lambda p: p["position"] + F.col("row") - 1).alias("position"),
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them (whole documents only), in the order of shards and positions.

    A document's copies are its rows repeated; documents without words are in no mix.  Rows that repeat doc_id, source
    and text are numbered in one task.
    """
    sized, _ = written(measured(docs), "sized")
    placed = mix(sized, source_table(sized), seed, whole=True)
    name = {c: unused_name(docs.columns, c) for c in ("entry", "row", "placed", "turn", "shard", "position")}
    repeats = has_rows(sized.groupBy(*ENTRY).count().where("count > 1"))
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))) if repeats else F.lit(1).cast("long")
    placed = placed.select(F.struct(*ENTRY).alias(name["placed"]), turn.alias(name["turn"]), F.col("shard").alias(name["shard"]), F.col("position").alias(name["position"]))
    placed = placed.withColumn(name["position"], F.col(name["position"]) + F.col(name["turn"]) - 1)
    text = docs["text"]
    entry = F.struct(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words_of(text).alias("size"), F.xxhash64(text).alias("mark"))
    number = F.row_number().over(Window.partitionBy(name["entry"]).orderBy(F.lit(1))) if repeats else F.lit(1)
    rows = docs.withColumn(name["entry"], entry).withColumn(name["row"], number.cast("long"))
    rows = rows.join(placed, (F.col(name["entry"]) == F.col(name["placed"])) & (F.col(name["row"]) == F.col(name["turn"])))
    return rows.orderBy(name["shard"], name["position"]).select(*[rows[f"`{c}`"] for c in docs.columns])
