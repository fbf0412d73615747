import json

import pytest

from sparkloom import cli
from sparkloom.errors import GraphError, IndexExists, ItemNotFound, VectorValidation
from sparkloom.sources import results
from sparkloom.sources.vector_store import IndexConfig, VectorStore


@pytest.mark.parametrize("one_file", [False, True])
def test_items(spark, tmp_path, one_file):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.create_index(one_file=one_file)
    with pytest.raises(IndexExists):
        VectorStore(spark, str(tmp_path / "s")).create_index()
    a = store.insert_item([1, 0, 0], {"name": "item1", "tag": "x"})
    b = store.insert_items([{"vector": [0, 1, 0], "metadata": {"name": "item2", "long": "y" * 2000}}, {"vector": [0, 0, 1]}])[0]
    found = store.query_items([1, 0.1, 0], 2).collect()
    assert [r["id"] for r in found] == [a, b] and found[0]["score"] > found[1]["score"]
    assert store.update_item(a, metadata={"tag": "z"}) == {"id": a, "version": 2}
    again = VectorStore(spark, str(tmp_path / "s"))
    (row,) = again.get_item(a).collect()
    assert json.loads(row["metadata"]) == {"name": "item1", "tag": "z"} and row["version"] == 2
    assert again.one_file == one_file and json.loads(again.get_item(b).first()["metadata"])["long"] == "y" * 2000
    again.delete_item(b)
    assert again.list_items().count() == 2 and again.list_items(limit=1, offset=1).count() == 1
    stats = again.get_stats().first()
    assert (stats["items"], stats["dimensions"], stats["distance_metric"]) == (2, 3, "cosine")
    for bad in ([float("nan"), 0, 0], [1, 2], []):
        with pytest.raises(VectorValidation):
            again.insert_items([{"vector": [1, 1, 1]}, {"vector": bad}])
    assert again.list_items().count() == 2
    with pytest.raises(ItemNotFound):
        again.update_item("none", [1, 1, 1])
    if one_file:
        with pytest.raises(ItemNotFound):
            again.delete_item("none")
        with pytest.raises(GraphError):
            again.insert_item([1, 1, 1], item_id=a)
    assert again.upsert_item(a, [0, 0, 2]) == a and again.query_items([0, 0, 1], 1).first()["id"] in (a, *[r["id"] for r in again.list_items().collect()])
    again.delete_index()
    assert not again.is_index_created()


def test_updates_as_a_whole(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "t"))
    store.create_index(IndexConfig(distance_metric="euclidean"))
    store.insert_item([1, 0], item_id="a")
    store.begin_update()
    store.insert_item([5, 5], item_id="b")
    store.cancel_update()
    assert store.list_items().count() == 1
    store.begin_update()
    store.insert_item([5, 5], item_id="b")
    store.end_update()
    assert VectorStore(spark, str(tmp_path / "t")).query_items([5, 5], 1).first()["score"] == 1.0
    store.insert_df(spark.createDataFrame([("c", [1.0, 2.0])], "id string, vector array<double>"))
    with pytest.raises(VectorValidation):
        store.insert_df(spark.createDataFrame([("d", [1.0])], "id string, vector array<double>"))
    assert store.list_items().count() == 3


def test_command_line(spark, tmp_path, capsys):
    graph, file = str(tmp_path / "g"), tmp_path / "g.json"
    file.write_text(json.dumps({"nodes": [{"id": "1", "labels": ["A"], "properties": {"x": 1.5, "s": "t"}}], "edges": []}))
    cli.main(["graph", "import", graph, str(file)], spark)
    cli.main(["graph", "query", graph, "CREATE (:A {x: 2.0})"], spark)
    capsys.readouterr()
    cli.main(["graph", "query", graph, "MATCH (a:A) WHERE a.x > $m RETURN a.x AS x, a.s AS s ORDER BY x", "--params", '{"m": 1}'], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "x | s" and out[2:] == ['1.5000 | "t"', "2.0000 | null"]
    cli.main(["graph", "query", graph, "MATCH (a:A) RETURN count(*) AS n", "--json"], spark)
    assert json.loads(capsys.readouterr().out) == {"columns": ["n"], "rows": [{"n": 2}]}
    cli.main(["graph", "stats", graph], spark)
    assert json.loads(capsys.readouterr().out)["node_count"] == 2
    cli.main(["graph", "export", graph, str(tmp_path / "out.json")], spark)
    assert len(json.loads((tmp_path / "out.json").read_text())["nodes"]) == 2


def test_result_as_json(spark):
    assert json.loads(results.to_json(spark.sql("select 1 as a, cast(null as string) as b"))) == {"columns": ["a", "b"], "rows": [{"a": 1, "b": None}]}


def test_a_save_that_was_broken_off_is_mended(spark, tmp_path, capsys):
    graph = str(tmp_path / "g")
    cli.main(["graph", "query", graph, "CREATE (:A {x: 1})-[:R]->(:A {x: 2})"], spark)
    (tmp_path / "g").rename(tmp_path / "g.old")
    capsys.readouterr()
    cli.main(["graph", "query", graph, "MATCH (a:A)-[:R]->(b:A) RETURN a.x AS x, b.x AS y", "--json"], spark)
    assert json.loads(capsys.readouterr().out)["rows"] == [{"x": 1, "y": 2}]
    cli.main(["graph", "query", graph, "MATCH (a:A) DETACH DELETE a"], spark)
    cli.main(["graph", "query", graph, "MATCH (a:A) RETURN count(*) AS n", "--json"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == [{"n": 0}] and not (tmp_path / "g.old").exists()


def test_items_of_equal_ids_and_filters(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.create_index()
    for _ in range(2):
        assert store.insert_items([{"id": "a", "vector": [1, 0], "metadata": {"t": "x", "n": 1}}, {"id": "b", "vector": [0, 1], "metadata": {"t": "y", "n": 2}}, {"id": "a", "vector": [1, 1], "metadata": {"t": "y", "n": 3}}]) == ["a", "b", "a"]
        assert sorted((r["id"], list(r["vector"])) for r in store.list_items().collect()) == [("a", [1, 1]), ("b", [0, 1])]
    assert [r["id"] for r in store.query_items([1, 0], 5, filter={"t": "y"}).collect()] == ["a", "b"]
    assert [r["id"] for r in store.query_items([1, 0], 5, filter={"t": "y", "n": 2}).collect()] == ["b"] and store.query_items([1, 0], 5, filter={"z": 1}).count() == 0
    with pytest.raises(GraphError):
        store.query_items([1, 0], 5, filter="t")
