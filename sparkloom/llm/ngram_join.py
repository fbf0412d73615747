"""Similarity join of documents on word shingles: chosen-path join with exact verification.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles (words between white space)
is at least 0.8; a text of fewer words is one shingle.  Documents with equal sets form a class; classes are joined,
so copies are never expanded.

Chosen paths: every set has ``COORDINATES`` minimum hashes, each a token sampled from the set in a way that equal
minima mean a shared token.  Each run has a pool of coordinates of its own.  It samples two of them and puts each set
into the two buckets of its minima there; a bucket of more than ``small`` sets is split in the same way by two more
coordinates of the pool, which depend on the path taken and are never sampled twice on a path, down to ``deepest``
levels.  ``miss`` gives the probability that a run loses a pair, ``plan_runs`` the number of runs for the target
recall: with the defaults five runs of twelve coordinates, which together lose a pair of similarity 0.8 with
probability 4.7e-5 at most (at the last level; 1e-7 where buckets are small at once), and fewer of higher similarity.
Small buckets are compared in full.  A bucket that sampling does not take apart (its sets are alike: more than
``DENSE`` of them stay together), or that is still large at the last level, is compared in full as well.

Work of a bucket: its sets are dealt into blocks of about ``BLOCK`` sets and ``BLOCK_TOKENS`` shingles.  A bucket of
one block is one row for each set.  Of a larger one, blocks are packed into one row each, and pairs of these rows meet,
so that the rows of n alike sets are n, and (n / BLOCK)^2 of blocks.  The comparisons within n sets that are alike
remain n^2 / 2, in tasks of bounded size.

Each pair is counted once: in the smallest id of the buckets that the two sets share.  In a bucket, sketches (one
byte of each minimum) first drop pairs that cannot reach the threshold (the test errs with probability below 1e-7);
documents left with a partner are read again, and their whole shingle sets decide.

No pair leaves a task: a task gives each set its number of links and its root in the task's spanning forest, and
components are found from these forest edges.

Defined results: texts of any length are read whole (a set may be a block of its own); null text counts as empty; a
document without words is a class and a group of its own, has no
links and stays (copies of it are for exact deduplication); classes and groups are named by their smallest doc_id
(null if all are null); rows that repeat a doc_id count as documents; an empty table gives no rows; other columns
are ignored by ``similarity_join``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, components, discard, forest, has_rows, prepare, runs, unused_name, written

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
SMALL = 2000
DEEPEST = 6
#: Share of a bucket's sets in one of its parts from which the bucket counts as alike throughout.
DENSE = 0.8
TARGET_RECALL = 1 - 5e-5
#: Sets and shingles in a block of a bucket, about.
BLOCK, BLOCK_TOKENS = 2000, 2_000_000
#: Rows of a block that are compared with the others at a time.
STRIP = 256
#: Words whose hashes a worker remembers.
MOST_WORDS = 150_000

_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    parts = (text or "").split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(parts) if len(h) < words else words, dtype=np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def minima(s: np.ndarray, block: int = 4096) -> np.ndarray:
    """Upper 32 bits of the minimum of each coordinate's hash over the set."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), block):
        part = s[a : a + block]
        for k in range(COORDINATES):
            v = (part * _MULT[k] + _PLUS[k]).min()
            if v < low[k]:
                low[k] = v
    return (low >> np.uint64(32)).astype(np.uint32)


def miss(similarity: float, pool: int, deepest: int) -> float:
    """Probability that a run with ``pool`` coordinates loses a pair whose buckets are all split ``deepest`` times.

    Of the pool's coordinates, a binomial number agrees; a node samples two of those not yet used on its path.
    """

    @lru_cache(None)
    def lost(left: int, agree: int, differ: int) -> float:
        if not left:
            return 0.0
        child = lost(left - 1, agree - 1, differ) if agree else 1.0
        both, one, none = math.comb(agree, 2), agree * differ, math.comb(differ, 2)
        return (both * child**2 + one * child + none) / (both + one + none)

    return sum(math.comb(pool, k) * similarity**k * (1 - similarity) ** (pool - k) * lost(deepest, k, pool - k) for k in range(pool + 1))


def plan_runs(threshold: float, recall: float, deepest: int) -> tuple[int, int]:
    """The smallest number of runs, each with its share of the coordinates, that find a pair at the threshold with
    probability ``recall``, and the levels they may split: fewer than ``deepest`` if it takes that, so that larger
    buckets are compared in full.
    """
    for levels in range(deepest, 0, -1):
        for n in range(1, COORDINATES // (levels + 1) + 1):
            if miss(threshold, COORDINATES // n, levels) ** n <= 1 - recall:
                return n, levels
    raise ValueError(f"{COORDINATES} coordinates do not reach a recall of {recall} at {threshold}")


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, mins = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                keys.append(set_key(s))
                sizes.append(len(s))
                mins.append(minima(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(mins, pa.binary())], names=["doc_id", "key", "n", "mins"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, key binary, n int, mins binary")


def _keyed(docs: DataFrame, words: int) -> DataFrame:
    """Texts with the keys of their shingle sets."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(shingles(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["text", "key"])

    return docs.select("text").mapInArrow(build, "text string, key binary")


def _children(rows: DataFrame, pool: int) -> DataFrame:
    """Two buckets of each (key, path): path hashed with a coordinate that it has not used and the set's minimum there."""
    free = F.filter(F.sequence(F.lit(0), F.lit(pool - 1)), lambda x: F.call_function("shiftright", F.col("used"), x).bitwiseAND(1) == 0)
    n = F.size("free")
    first = F.pmod(F.xxhash64("path", F.lit(0)), n).cast("int")
    step = F.pmod(F.xxhash64("path", F.lit(1)), n - 1).cast("int") + 1
    both = rows.withColumn("free", free).withColumn("own", F.explode(F.array(F.get("free", first), F.get("free", F.pmod(first + step, n)))))
    at = F.col("run") * pool + F.col("own")
    child = F.xxhash64("path", at, F.substring(F.col("mins"), 4 * at + 1, F.lit(4)))
    used = F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("own")))
    return both.select("key", "n", "run", used.alias("used"), child.alias("path"), F.col("path").alias("parent"), F.col("many").alias("parent_many"), F.col("mass").alias("parent_mass"))


def _buckets(classes: DataFrame, n_runs: int, small: int, deepest: int) -> tuple[DataFrame, list[str]]:
    """``key, path, many, mass`` for each set and each final bucket of two sets or more that it is in."""
    pool = COORDINATES // n_runs
    paths = classes.select("key", "n", "mins", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run"))
    nothing = F.lit(0).cast("long")
    level = _children(paths.withColumns({"path": F.col("run").cast("long") + 1000, "used": nothing, "many": nothing, "mass": nothing}), pool)
    out, made = None, []
    own = ["key", "path", "many", "mass"]
    for depth in range(deepest):
        counted = attach(level, ["path"], F.col("key"), {"many": F.count("*"), "mass": F.sum("n")}, {"many": F.sum("many"), "mass": F.sum("mass")})
        if depth:
            counted = attach(counted, ["parent"], F.col("key"), {"top": F.max("many")}, {"top": F.max("top")})
        counted, path = written(counted.where("many > 1") if not depth else counted, "buckets")
        made.append(path)
        live = counted
        if depth:
            # a bucket that sampling does not take apart (its sets are alike) is final itself
            dense = F.col("top") > DENSE * F.col("parent_many")
            whole = counted.where(dense).select("key", F.col("parent").alias("path"), F.col("parent_many").alias("many"), F.col("parent_mass").alias("mass"))
            out = out.unionByName(whole.distinct())
            live = counted.where(~dense & (F.col("many") > 1))
        last = depth == deepest - 1
        here = (live if last else live.where(F.col("many") <= small)).select(*own)
        out = here if out is None else out.unionByName(here)
        if last or not has_rows(large := live.where(F.col("many") > small)):
            break
        level = _children(large.select(*own, "n", "run", "used").join(classes.select("key", "mins"), "key"), pool)
    return out, made


def _pairs(side: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which pairs (i in a..b, j > i) a task compares: within a block, or across its two blocks."""
    allowed = (side[a:b, None] | side[None, :]) == 3
    return allowed & (np.arange(len(side))[None, :] > np.arange(a, b)[:, None])


def _shared_least(left: np.ndarray, right: np.ndarray) -> int:
    both = np.intersect1d(left, right, assume_unique=True)
    return int(both[0]) if len(both) else 0


class _Earlier:
    """Buckets before a task's own in the order of their ids: a pair belongs to the smallest bucket that both sets are in."""

    def __init__(self, paths: list[np.ndarray], path: int):
        self.paths, self.path, self.marks = paths, path, None

    def _mark(self) -> np.ndarray:
        """Whether a set is in an earlier bucket, for the buckets that two sets or more are in."""
        before = [p[p < self.path] for p in self.paths]
        owner = np.repeat(np.arange(len(before)), [len(p) for p in before])
        ids, column, count = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
        keep = count[column] > 1
        marks = np.zeros((len(before), int((count > 1).sum())), dtype=np.uint8)
        marks[owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]] = 1
        return marks

    def none(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share no earlier bucket."""
        if len(i) < 8:
            return np.fromiter((_shared_least(self.paths[a], self.paths[b]) == self.path for a, b in zip(i.tolist(), j.tolist(), strict=True)), dtype=bool, count=len(i))
        if self.marks is None:
            self.marks = self._mark()
        rows = np.unique(i)
        shared = np.zeros((len(rows), len(self.paths)), dtype=np.float32)
        for c in range(0, self.marks.shape[1], 512):
            part = self.marks[:, c : c + 512].astype(np.float32)
            shared += part[rows] @ part.T
        return shared[np.searchsorted(rows, i), j] == 0


class _Block:
    """Sets of a task with what tells that two of them cannot reach the threshold."""

    def __init__(self, path: int, n: np.ndarray, sketch: np.ndarray, paths: list[np.ndarray]):
        self.path, self.n, self.sketch, self.paths = path, n, sketch, paths

    @classmethod
    def of(cls, group: pa.Table) -> _Block:
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(group.num_rows, COORDINATES)
        return cls(group.column("path")[0].as_py(), group.column("n").to_numpy().astype(np.float64), sketch, [np.frombuffer(p, dtype=np.int64) for p in group.column("paths").to_pylist()])

    def hopeful(self, side: np.ndarray, threshold: float) -> np.ndarray:
        """Positions of the sets that have a partner by sketch, size and bucket."""
        n, sketch = self.n, np.ascontiguousarray(self.sketch.T)
        # matches of b-bit minima: binomial with share j + (1 - j) / 256; six deviations below the mean at the threshold
        share = threshold + (1 - threshold) / 256
        least = math.floor(COORDINATES * share - 6 * math.sqrt(COORDINATES * share * (1 - share)))
        found, earlier = np.zeros(len(n), dtype=bool), _Earlier(self.paths, self.path)
        for a in range(0, len(n), STRIP):
            b = min(a + STRIP, len(n))
            allowed = _pairs(side, a, b)
            allowed &= np.minimum(n[a:b, None], n[None, :]) >= threshold * np.maximum(n[a:b, None], n[None, :]) - 1e-9
            equal = np.zeros(allowed.shape, dtype=np.uint8)
            for c in sketch:
                equal += c[a:b, None] == c[None, :]
            i, j = np.nonzero(allowed & (equal >= least))
            if len(i):
                i = i + a
                mine = earlier.none(i, j)
                found[i[mine]] = found[j[mine]] = True
        return np.flatnonzero(found)


#: What is left of a set in a task: the block pair it is in, and on which side of it.
_LEFT = "key binary, path long, a int, b int, side int, paths binary"


def _left(path: int, a: int, b: int, keys: list[bytes], side: np.ndarray, paths: list[bytes]) -> pa.RecordBatch:
    same = lambda v, kind: pa.array([v] * len(keys), kind)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), same(path, pa.int64()), same(a, pa.int32()), same(b, pa.int32()), pa.array(side, pa.int32()), pa.array(paths, pa.binary())], names=["key", "path", "a", "b", "side", "paths"])


def _candidates(rows: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """Sets with a possible partner, by task; ``rows``: key, path, blocks, block, n, sketch, paths."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["path"]):
            side = np.full(group.num_rows, 3)
            if group.num_rows > 1 and len(at := _Block.of(group).hopeful(side, threshold)):
                left = group.take(pa.array(at))
                yield _left(left.column("path")[0].as_py(), 0, 0, left.column("key").to_pylist(), side[at], left.column("paths").to_pylist())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["path", "block"]):
            one = lambda c: group.column(c)[0].as_py()  # noqa: B023, E731
            joined = lambda c: b"".join(group.column(c).to_pylist())  # noqa: B023, E731
            ends = np.cumsum([len(p) for p in group.column("paths").to_pylist()]).astype(np.int64).tobytes()
            values = [one("path"), one("blocks"), one("block"), joined("key"), group.column("n").to_numpy().astype(np.int64).tobytes(), joined("sketch"), joined("paths"), ends]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["path", "blocks", "block", "keys", "n", "sketch", "paths", "ends"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["path", "a", "b"]):
            r = group.to_pylist()
            n = np.concatenate([np.frombuffer(x["n"], dtype=np.int64) for x in r]).astype(np.float64)
            raw = [x["paths"][c:d] for x in r for c, d in itertools.pairwise([0, *np.frombuffer(x["ends"], dtype=np.int64).tolist()])]
            sketch = np.frombuffer(b"".join(x["sketch"] for x in r), dtype=np.uint8).reshape(-1, COORDINATES)
            keys = [x["keys"][k : k + 16] for x in r for k in range(0, len(x["keys"]), 16)]
            first = len(r[0]["keys"]) // 16
            side = np.full(len(n), 3) if len(r) == 1 else np.repeat([1, 2], [first, len(n) - first])
            at = _Block(r[0]["path"], n, sketch, [np.frombuffer(p, dtype=np.int64) for p in raw]).hopeful(side, threshold)
            if len(at):
                yield _left(r[0]["path"], r[0]["a"], r[0]["b"], [keys[i] for i in at], side[at], [raw[i] for i in at])

    one = rows.where("blocks = 1").select("key", "path", "n", "sketch", "paths").repartition("path").sortWithinPartitions("path", "key")
    out, made = one.mapInArrow(within, _LEFT), []
    large = rows.where("blocks > 1")
    if has_rows(large):
        packed = large.repartition("path", "block").sortWithinPartitions("path", "block", "key").mapInArrow(pack, "path long, blocks int, block int, keys binary, n binary, sketch binary, paths binary, ends binary")
        packed, path = written(packed, "blocks")
        made.append(path)
        ends = packed.select("path", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        ends = ends.select("path", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
        met = ends.join(packed.drop("blocks"), ["path", "block"]).repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "block")
        out = out.unionByName(met.mapInArrow(across, _LEFT))
    return out, made


def _verify(keys: list[bytes], sets: list[np.ndarray], side: np.ndarray, paths: list[np.ndarray], path: int, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by the partners' class sizes) and forest root of each set of a task."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.append(True, tokens[1:] != tokens[:-1])
    group = np.cumsum(first) - 1
    count = np.bincount(group)
    keep = count[group] > 1  # tokens of one set only are in no intersection
    column, owner = np.cumsum(first & keep)[keep] - 1, owner[keep]
    shared = np.zeros((m, m), dtype=np.float32)
    width = 4096 if m <= 1000 else 1024
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((m, min(width, total - a)), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        shared += x @ x.T
    links, root, earlier = np.zeros(m, dtype=np.int64), np.arange(m), _Earlier(paths, path)
    for a in range(0, m, STRIP):  # pairs are held for a strip at a time
        b = min(a + STRIP, m)
        union = size[a:b, None] + size[None, :] - shared[a:b]
        i, j = np.nonzero(_pairs(side, a, b) & (shared[a:b] >= threshold * union - 1e-6))
        exact = shared[a:b][i, j].astype(np.float64) / union[i, j] >= threshold
        i, j = i[exact] + a, j[exact]
        mine = earlier.none(i, j)
        i, j = i[mine], j[mine]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = forest(m, root[i], root[j])[root]
    return links, root


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = TARGET_RECALL, small: int = SMALL, deepest: int = DEEPEST, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, class_size, n_links, group_id, kept`` of each row of ``docs``.

    Buckets of at most ``small`` sets are compared in full: by default as many as a block holds, as splitting them costs
    more than comparing their sketches.

    ``class_id`` is the smallest doc_id with an equal shingle set, ``n_links`` the number of other documents at the
    threshold or above (copies included), ``group_id`` the smallest doc_id reachable by links, ``kept`` whether the
    document is the one of its group that stays.
    """
    spark = docs.sparkSession
    prepare(spark)
    profiles, made = written(_profiles(docs, words), "profiles")
    used = [made]
    # one row of each class; `first` of equal sets is any of them
    classes = profiles.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.any_value("n").alias("n"), F.any_value("mins").alias("mins"))
    classes, made = written(classes, "classes")
    used.append(made)
    n_runs, levels = plan_runs(threshold, recall, deepest)
    buckets, made_paths = _buckets(classes, n_runs, small, levels)
    used += made_paths
    buckets, made = written(buckets.distinct(), "final")  # read twice
    used.append(made)
    sorted_paths = F.array_sort(F.collect_list("path"))
    packed = lambda c: F.unhex(F.array_join(F.transform(c, _little_endian), ""))
    per_key = buckets.groupBy("key").agg(packed(sorted_paths).alias("paths"))
    stride = F.concat(*[F.substring(F.col("mins"), 4 * k + 1, 1) for k in range(COORDINATES)])
    sketches = classes.select("key", "n", stride.alias("sketch")).join(per_key, "key")
    blocks = F.ceil(F.greatest(F.col("many") / F.lit(block), F.col("mass") / F.lit(BLOCK_TOKENS))).cast("int")
    rows = buckets.select("key", "path", blocks.alias("blocks"), F.pmod(F.xxhash64("key", "path"), blocks).cast("int").alias("block")).join(sketches, "key")
    candidates, made_paths = _candidates(rows, threshold)
    used += made_paths
    hopeful, made = written(candidates, "hopeful")
    used.append(made)

    # the texts of documents with a partner are read again; their shingle sets go to the tasks
    wanted = hopeful.groupBy("key").agg(F.collect_list(F.struct("path", "a", "b", "side")).alias("tasks"), F.any_value("paths").alias("paths"))
    wanted = wanted.join(classes.select("key", "rep", "weight"), "key").withColumnRenamed("key", "want")
    wanted, made = written(wanted, "wanted")
    used.append(made)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(wanted.where("rep is not null"), F.col("doc_id") == F.col("rep")).drop("doc_id", "rep")
    if has_rows(wanted.where("rep is null")):  # classes without any doc_id are found by their shingles
        nameless = _keyed(rows.where("doc_id is null"), words).dropDuplicates(["key"])
        texts = texts.unionByName(nameless.join(wanted.where("rep is null"), F.col("key") == F.col("want")).drop("key", "rep"))
    if has_rows(profiles.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")):
        texts = texts.dropDuplicates(["want", "text"])  # rows that repeat doc_id and text

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "want", "weight", "paths", "tasks"]
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            for text, want, weight, paths, tasks in zip(*(c.to_pylist() for c in cols), strict=True):
                s = shingles(text, words)
                if set_key(s) != want:  # another row of this doc_id
                    continue
                t = len(tasks)
                part = lambda k, kind: pa.array([x[k] for x in tasks], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([want] * t, pa.binary()), pa.array([weight] * t, pa.int64()), pa.array([paths] * t, pa.binary()), part("path", pa.int64()), part("a", pa.int32()), part("b", pa.int32()), part("side", pa.int32()), pa.array([s.tobytes()] * t, pa.binary())],
                    names=["key", "weight", "paths", "path", "a", "b", "side", "tokens"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["path", "a", "b"]):
            keys = group.column("key").to_pylist()
            at = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]  # texts of one doc_id with equal shingles
            if len(at) < 2:
                continue
            group = group.take(pa.array(at))
            keys = [keys[i] for i in at]
            binary = lambda c, kind: [np.frombuffer(x, dtype=kind) for x in group.column(c).to_pylist()]  # noqa: B023, E731
            links, root = _verify(keys, binary("tokens", np.uint64), group.column("side").to_numpy(), binary("paths", np.int64), group.column("path")[0].as_py(), group.column("weight").to_numpy(), threshold)
            some = np.flatnonzero(links > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(links[some]), pa.array([keys[i] for i in root[some]], pa.binary())], names=["key", "links", "root"])

    tokens = texts.mapInArrow(expand, "key binary, weight long, paths binary, path long, a int, b int, side int, tokens binary")
    tokens = tokens.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "key")
    found, made = written(tokens.mapInArrow(verify, "key binary, links long, root binary"), "links")
    used.append(made)
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = classes.select("key", "rep", "weight").join(linked, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    info = info.withColumn("root", F.coalesce("root", "key"))
    info = attach(info, ["root"], F.col("key"), {"group_id": F.min("rep")}, {"group_id": F.min("group_id")})
    info, made = written(info.select("key", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), "group_id"), "info")
    discard(spark, *used[1:])
    return _with_classes(profiles, info)


def _little_endian(x):
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])


def _with_classes(profiles: DataFrame, info: DataFrame) -> DataFrame:
    """Each document with its class's values; a class is met salt by salt."""
    thin = profiles.select("doc_id", "key", "n")
    # the class row is sent to the salts in which the class has documents
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(48)).cast("int")
    dealt = thin.withColumn("salt", salt)
    wide = dealt.where("n > 0").select("key", "salt").distinct().groupBy("key").agg(F.collect_list("salt").alias("salts"))
    values = info.join(wide, "key").withColumn("salt", F.explode("salts")).drop("salts")
    out = dealt.join(values, ["key", "salt"], "left")
    words = F.col("n") > 0
    return out.select(
        "doc_id",
        F.when(words, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(words, F.col("weight")).otherwise(1).cast("long").alias("class_size"),
        F.when(words, F.col("links") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(words, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"),
        F.when(words, F.col("doc_id").eqNullSafe(F.col("group_id"))).otherwise(True).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group of linked documents the one with the smallest doc_id.

    A doc_id names one document: rows that share it stay or go together.  Rows without one cannot be named and stay.
    """
    name = unused_name(docs.columns, "gone")
    gone, _ = written(similarity_join(docs, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "near")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
