"""Helpers the training-data operators have in common.

* ``written`` cuts lineage with a Parquet table in the folder that all executors share;
* ``attach`` puts a group's aggregate on each of its rows without gathering the group in one task;
* ``components`` finds connected components from edges, again without hubs meeting in one task;
* ``runs`` reads key-sorted Arrow batches group by group.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that one key's rows are dealt into before they are merged.
SALTS = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only if none is set and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[list[str]] = []


@contextmanager
def temporary() -> Iterator[list[str]]:
    """The paths of all tables that ``written`` makes meanwhile, for ``discard`` when no plan reads them any more."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and the path."""
    path = new_path(df.sparkSession, name)
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


#: Rows and bytes that go to a Python worker at a time, where the session does not say otherwise: texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**63 - 1), str(32 << 20))}


def unused_name(columns: Iterable[str], stem: str) -> str:
    """``stem`` with as many underscores before it as make it differ from all ``columns`` (names ignore case)."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """What operators with Python code need: small batches, and this package on the workers' path.

    The package is sent once to each application through Spark's own file server, so that executors need not have it
    installed.
    """
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, own)
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / f"{package.name}-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted(*cols: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def thinned(df: DataFrame, key: str, most: int, rows: int, slack: int = 4) -> DataFrame:
    """About ``slack * most`` of ``rows`` rows, by a hash of ``key``; all if there are no more than that.

    What a bounded sample is then ordered and cut from: tasks send it few rows, however many tasks there are.
    """
    share = slack * most / max(rows, 1)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))


def attach(df: DataFrame, keys: list[str], spread: Column, partial: dict[str, Column], final: dict[str, Column], salts: int = SALTS) -> DataFrame:
    """Each row of ``df`` with aggregates of its key group.

    ``partial`` aggregates by key and salt, ``final`` merges those by key and may use the names of ``partial``.
    Null keys match each other.  A key's rows meet only within a salt, so a key with a third of all rows is
    spread over ``salts`` tasks; the merge sees at most ``salts`` rows of a key.
    """
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = dealt.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    merged = parts.groupBy(*keys).agg(F.collect_list("__salt").alias("__salts"), *[c.alias(n) for n, c in final.items()])
    values = merged.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *final, F.explode("__salts").alias("__s"))
    on = (F.col("__salt") == F.col("__s")) & _all(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
    return dealt.join(values, on).drop("__salt", "__s", *[f"__k{i}" for i in range(len(keys))])


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the undirected ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each is a grouped minimum attached to the edges in salted
    form, so that hubs do not meet in one task.  Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    kept, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if not has_rows(kept):
        return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:  # settles in O(log^2) rounds
        both = kept.union(kept.select("v", "u"))
        near = attach(both, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")}).withColumn("m", F.least("u", "m"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = attach(large, ["u"], F.col("v"), {"m": F.min("v")}, {"m": F.min("m")})
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new = written(small, "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(spark, path)
        kept, path = after, new
        if state == seen:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The root, its smallest node, of each of n nodes after joining left[i] with right[i]."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(higher := root[root], root):
            root = higher
    return root


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal ``keys`` from batches of a partition sorted by them, in order; only one is held at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            values = c.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
