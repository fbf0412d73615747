"""Registered queries against their SQL oracles, plans, and streams."""

import collections
import os
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from sparkloom.functions import vectors
from sparkloom.operators.ivf import VectorIndex
from sparkloom.operators.knn import index_of, nearest_to_each
from sparkloom.queries import ORACLE, QUERIES, SPECS, graph_of
from sparkloom.sources.catalog import Catalog
from sparkloom.streaming.ingest import stream_edges, stream_nodes, with_streamed


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return c


def cells(rows, order):
    plain = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = df.collect(), want.fetchall()
    assert cells(got, [df.columns.index(n) for n in sorted(names)]) == cells(expected, [names.index(n) for n in sorted(names)])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["seek_param"](spark, sf))
    assert "EqualTo(c_custkey,42)" in text and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text
    assert "StringContains(p_name,ring)" in plan(QUERIES["filter_contains"](spark, sf))


def test_foreign_keys_need_one_join_per_hop_at_most(spark, sf):
    assert plan(QUERIES["expand_both"](spark, sf)).count("Join") == 1
    assert plan(QUERIES["having"](spark, sf)).count("Join") == 1
    assert plan(QUERIES["four_hop_revenue"](spark, sf)).count("Join") <= 4


def test_absence_is_an_anti_join_and_sorting_with_a_limit_is_top_k(spark, sf):
    assert "LeftAnti" in plan(QUERIES["optional_anti"](spark, sf))
    assert "TakeOrderedAndProject" in plan(QUERIES["knn_call"](spark, sf)) and "TakeOrderedAndProject" in plan(QUERIES["order_nonprojected"](spark, sf))


def test_no_query_runs_python_workers(spark, sf):
    for name in SPECS:
        text = plan(QUERIES[name](spark, sf))
        assert "Python" not in text and "Arrow" not in text, name


def test_a_kernel_in_where_and_return_is_computed_once(spark, sf):
    from sparkloom.queries import Spec

    text = "MATCH (e:Vec) WHERE vector_similarity(e.embedding,$q) > 0.1 RETURN e.vec_id AS id, vector_similarity(e.embedding,$q) AS s ORDER BY s DESC, id LIMIT 5"
    df = Spec("Vec", "", text, query_vector=True)(spark, sf)
    rows = df.collect()
    assert len(rows) == 5 and rows[0].s == pytest.approx(1) and all(r.s > 0.1 for r in rows)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_many_queries_go_in_blocks(spark, sf, monkeypatch, metric):
    from sparkloom.operators import knn

    vecs = graph_of(spark, sf).table("embeddings")
    base, asked = vecs.selectExpr("concat('v', vec_id) as id", "embedding as vec"), vecs.where("vec_id < 30").selectExpr("concat('v', vec_id) as q", "embedding as vec")
    base = base.unionByName(spark.createDataFrame([("zero", [0.0] * 64), ("short", [1.0]), ("none", None)], "id string, vec array<float>"))
    found = lambda: {(r.q, r.id): (round(r.score, 6), r.rk) for r in nearest_to_each(base, asked, 2, metric).collect()}
    whole = found()
    monkeypatch.setattr(knn, "MOST_QUERIES", 10)
    assert found() == whole and len(whole) == 60


def test_index_recall(spark, sf):
    """Every vector asked for its ten nearest: nine in ten true ones at least, and k results also from empty cells."""
    vecs = graph_of(spark, sf).table("embeddings")
    base, asked = vecs.selectExpr("vec_id as id", "embedding as vec"), vecs.selectExpr("vec_id as q", "embedding as vec")
    exact = collections.defaultdict(dict)
    for r in nearest_to_each(base, asked, 500).collect():
        exact[r.q][r.id] = (r.rk, r.score)
    index = VectorIndex.build(base)
    found = index.search_each(asked, 10).collect()
    assert all(abs(exact[r.q][r.id][1] - r.score) < 1e-6 for r in found) and len(found) == 10 * len(exact)
    assert sum(exact[r.q][r.id][0] <= 10 for r in found) >= 0.9 * len(found)
    q = [float(x) for x in vecs.where("vec_id = 1").first()["embedding"]]
    one = index.search(q, 5).collect()
    assert one[0]["id"] == 1 and len(one) == 5 and index.search(q, vecs.count()).count() == vecs.count()
    assert len(index.search_each(asked.where("q < 3"), 300, probes=1).collect()) == 3 * min(300, vecs.count() - 1)
    assert index.search([1.0, 2.0], 5).count() == 0 and VectorIndex.build(base.limit(0)) is None


@pytest.mark.parametrize("kind", ("long", "string"))
def test_blocks_hold_large_cells_and_many_queries(spark, monkeypatch, kind):
    """All cells probed, so that the result is brute force's: 60 of 150 vectors are copies, and blocks hold 20 vectors or queries."""
    from sparkloom.operators import ivf, knn

    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[30:90] = x[30]
    name = (lambda i: i) if kind == "long" else "v{:03d}".format
    rows = spark.createDataFrame([(name(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(None, [1.0] * 8), (name(200), None), (name(201), [float("nan")] * 8)], f"id {kind}, vec array<float>")
    asked = rows.withColumnRenamed("id", "q")
    monkeypatch.setattr(ivf, "MOST_IN_BLOCK", 20)
    monkeypatch.setattr(knn, "MOST_IN_BLOCK", 20)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 12)
    np.fill_diagonal(score, -np.inf)
    want = {(name(q), name(int(i)), rk) for q in range(150) for rk, i in enumerate(np.lexsort((np.arange(150), -score[q]))[:5], 1)}
    index = VectorIndex.build(rows, cells=6)
    first, parts = index.blocks()
    assert max(parts) >= 3 and len({b for f, p in zip(first, parts, strict=True) for b in range(f, f + p)}) == (first + parts).max()
    for found in (index.search_each(asked, 5, probes=6), knn.nearest_of_all(rows, 5, ivf.DIGITS, asked), knn.nearest_of_all(rows, 5, ivf.DIGITS)):
        assert {(r.q, r.id, r.rk) for r in found.collect()} == want


def test_queries_are_sent_to_blocks_not_to_each_cell(spark, sf, monkeypatch):
    """What a search for many vectors shuffles does not grow with the cells that it probes, also where nothing is small enough to broadcast."""
    from sparkloom.operators import ivf

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    vecs = graph_of(spark, sf).table("embeddings")
    index = VectorIndex.build(vecs.selectExpr("vec_id as id", "embedding as vec"), cells=200)
    frames, kept = [], ivf.written
    monkeypatch.setattr(ivf, "written", lambda df, name: frames.append(df) or kept(df, name))
    frames.append(index.search_each(vecs.selectExpr("vec_id as q", "embedding as vec"), 1, probes=len(index.centres)))
    n = vecs.count()
    assert frames[-1].count() == n
    for df in frames:
        df.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # items once, queries once and one row of each query for each of some 12 blocks
    assert sum(map(shuffled, frames)) <= n * (1 + 2 * 20)


def test_many_pairs_are_no_rows(spark, sf, monkeypatch):
    from sparkloom.operators import knn

    vecs = graph_of(spark, sf).table("embeddings")
    base, asked = vecs.selectExpr("vec_id as id", "embedding as vec"), vecs.where("vec_id % 50 = 0").selectExpr("vec_id as q", "embedding as vec")
    found = lambda: nearest_to_each(base, asked, 3, digits=6)
    few = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(knn, "MOST_PAIRS", 10)
    assert "NestedLoopJoin" not in plan(found()) and sorted(map(tuple, found().collect())) == few


def shuffled(df):
    """Rows that an executed plan shuffled."""
    left, out = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        elif name == "ShuffleExchangeExec":
            out += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return out


def test_index_is_kept_until_nodes_change(spark, sf):
    g = SPECS["knn_approximate"].engine(spark, sf)
    first = index_of(g.catalog)
    assert index_of(g.catalog) is first
    g.set_node_vector("Vec:0", [1.0] * 64)
    assert index_of(g.catalog) is not first


def test_conditions_are_applied_before_paths_grow(spark, sf, monkeypatch):
    """The frontiers of the query with a WHERE start from its nodes only, whichever end they are at."""
    from sparkloom.operators import match

    sizes = []

    def counted(df, name):
        out = kept(df, name)
        sizes.append(out.count())
        return out

    kept = match.written
    monkeypatch.setattr(match, "written", counted)
    n = graph_of(spark, sf).table("embeddings").count()
    for text in ("(a:Vec)-[:CALLS:IMPORTS*1..4]->(b:Vec) WHERE a.vec_id < 4", "(b:Vec)-[:CALLS:IMPORTS*1..4]->(a:Vec)  WHERE a.vec_id < 4"):
        sizes.clear()
        rows = replace(SPECS["varlen_distinct"], text=f"MATCH {text} RETURN DISTINCT a.vec_id AS a, b.vec_id AS b")(spark, sf).collect()
        assert rows and max(sizes) <= 4 * 4**2 < n


def test_index_clusters_files(spark, sf):
    g = SPECS["inline_props"].engine(spark, sf)
    g.create_property_index("Customer", "c_mktsegment")
    text = plan(g.cypher("MATCH (c:Customer {c_mktsegment:'BUILDING'}) RETURN c.c_custkey AS k"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "rangepartitioning" not in text and "Sort" not in text


def test_whole_table_queries_leave_no_row_out(spark, sf, db):
    """The forms of the examples without their id filters: brute force over all rows, not over the oracle's SQL."""
    n = db.execute("select count(*) from embeddings").fetchone()[0]
    edges = [(i % n, (i * 7 + 3) % n, ("CALLS", "IMPORTS", "REFERENCES")[i % 3]) for i in range(2 * n)]

    def walks(kinds, most):
        found = collections.Counter()
        out = collections.defaultdict(list)
        for s, d, t in edges:
            if t in kinds:
                out[s].append(d)

        def go(path):
            if len(path) > 1:
                found[path[0], path[-1], len(path) - 1] += 1
            for d in out[path[-1]] if len(path) <= most else []:
                if d not in path:
                    go((*path, d))

        for a in range(n):
            go((a,))
        return found

    paths = collections.Counter()
    for (a, _, length), times in walks(("CALLS", "REFERENCES"), 4).items():
        paths[a] += times * (length >= 2)
    assert {r.a: r.paths for r in QUERIES["varlen_2_4"](spark, sf).collect()} == {a: c for a, c in paths.items() if c}
    assert {(r.a, r.b) for r in QUERIES["varlen_distinct"](spark, sf).collect()} == {(a, b) for a, b, _ in walks(("CALLS", "IMPORTS"), 4)}
    assert collections.Counter(r.q for r in QUERIES["knn_all"](spark, sf).collect()) == dict.fromkeys(range(n), 3)
    for name, table in (("expand_in", "orders"), ("to_integer_string", "customer")):
        assert QUERIES[name](spark, sf).count() == db.execute(f"select count(*) from {table}").fetchone()[0]


def test_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.cosine(df.a, df.b), vectors.similarity("euclidean", df.a, df.b), vectors.norm(vectors.normalized(df.a)), vectors.is_valid(df.a)).collect()
    assert tuple(rows[0]) == (1.0, 1.0, 1.0, True) and tuple(rows[1]) == (0.0, 0.5, 0.0, True) and rows[2][0] is None


def test_streams(spark, tmp_path):
    spark.createDataFrame([("x:1", 1), ("x:2", 2)], "_id string, v long").write.parquet(str(tmp_path / "in_nodes"))
    spark.createDataFrame([("e1", "x:1", "x:2")], "_eid string, _src string, _dst string").write.parquet(str(tmp_path / "in_edges"))
    read = lambda schema, name: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    stream_nodes(read("_id string, v long", "in_nodes"), str(tmp_path / "nodes"), str(tmp_path / "c1")).awaitTermination(60)
    stream_edges(read("_eid string, _src string, _dst string", "in_edges"), str(tmp_path / "edges"), str(tmp_path / "c2")).awaitTermination(60)
    from sparkloom.engine import GraphEngine

    g = GraphEngine(spark, with_streamed(Catalog(spark), spark, {("X",): str(tmp_path / "nodes")}, {"R": str(tmp_path / "edges")}))
    assert [tuple(r) for r in g.cypher("MATCH (a:X)-[:R]->(b:X) RETURN a.v AS a, b.v AS b").collect()] == [(1, 2)]
