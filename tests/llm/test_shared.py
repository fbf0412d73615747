import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm._shared import attach, components, forest, runs


def test_attach_gives_every_row_its_group(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = attach(df, ["k"], F.col("id"), {"top": F.max("id"), "n": F.count("*")}, {"top": F.max("top"), "n": F.sum("n")}).collect()
    assert len(got) == 300
    for r in got:
        mine = [i for i, k in rows if k == r.k]
        assert (r.top, r.n) == (max(mine), len(mine))


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    assert {k: v for k, v in want.items() if k in got} == got and all(k in got or v == k for k, v in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_runs():
    assert forest(5, np.array([0, 3]), np.array([1, 1])).tolist() == [0, 0, 2, 0, 4]
    batches = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": list("abcdef")}).to_batches(max_chunksize=2)
    assert [g.column("v").to_pylist() for g in runs(batches, ["k"])] == [["a", "b"], ["c", "d", "e"], ["f"]]
    assert list(runs([], ["k"])) == []
