"""The behaviour of statements on small graphs: rows in, rows out."""

import json
import math

import pytest
from pyspark.errors import PySparkException

from sparkloom.engine import GraphEngine
from sparkloom.errors import CypherTypeError, EdgeNotFound, GraphError, NodeHasEdges, NodeNotFound


@pytest.fixture
def g(spark):
    return GraphEngine(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(df):
    (r,) = df.collect()
    return tuple(r)


PEOPLE = "CREATE (a:Person {name:'Alice', age:30, dept:'Eng'}), (b:Person {name:'Bob', age:25, dept:'Eng'}), (c:Person {name:'Carol', age:35, dept:'Mkt'})"
KNOWS = PEOPLE + ", (a)-[:KNOWS {since:2020}]->(b), (a)-[:KNOWS]->(c)"


def test_filter_order_limit_params(g):
    g.cypher(PEOPLE)
    assert rows(g.cypher("MATCH (p:Person) WHERE p.age >= 30 RETURN p.name AS n")) == [("Alice",), ("Carol",)]
    assert [r[0] for r in g.cypher("MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 2").collect()] == ["Carol", "Alice"]
    assert g.cypher("MATCH (p:Person) WHERE p.age > $m RETURN p.name", {"m": 28}).count() == 2
    assert g.cypher("MATCH (p:Person) WHERE p.age > $m RETURN p.name", '{"m": 28}').count() == 2
    assert g.cypher("MATCH (p:Person) RETURN p.name").columns == ["p.name"]


def test_one_hop_and_edge_properties(g):
    g.cypher(KNOWS)
    assert rows(g.cypher("MATCH (a:Person {name:'Alice'})-[:KNOWS]->(b) RETURN b.name AS n")) == [("Bob",), ("Carol",)]
    assert rows(g.cypher("MATCH (a)-[r:KNOWS {since:2020}]->(b) RETURN b.name AS n, r.since AS s")) == [("Bob", 2020)]
    assert rows(g.cypher("MATCH (b)<-[:KNOWS]-(a) RETURN a.name AS a, b.name AS b")) == [("Alice", "Bob"), ("Alice", "Carol")]
    assert g.cypher("MATCH (a:Person)-[:KNOWS]-(b:Person) RETURN a.name, b.name").count() == 4
    assert g.cypher("MATCH (a)-->(b) RETURN a.name").count() == 2


def test_optional_match_keeps_rows(g):
    g.cypher(PEOPLE + ", (a)-[:KNOWS]->(b)")
    assert rows(g.cypher("MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q) RETURN p.name AS p, q.name AS q")) == [("Alice", "Bob"), ("Bob", None), ("Carol", None)]
    assert rows(g.cypher("MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q) WHERE q IS NULL RETURN p.name AS p")) == [("Bob",), ("Carol",)]
    # a WHERE after it is a filter of its own
    assert rows(g.cypher("MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q) WHERE q.age < 30 RETURN p.name AS p")) == [("Alice",)]
    assert rows(g.cypher("OPTIONAL MATCH (n:Nothing) RETURN n.x AS x")) == [(None,)]
    assert rows(g.cypher("MATCH (p:Person) OPTIONAL MATCH (p)-[:KNOWS]->(q {age: p.age - 5}) RETURN p.name AS p, q.name AS q"))[0] == ("Alice", "Bob")


def test_variable_length_chain_and_cycle(g):
    g.cypher("CREATE (a:N {name:'A'})-[:NEXT]->(b:N {name:'B'})-[:NEXT]->(c:N {name:'C'})-[:NEXT]->(d:N {name:'D'})")
    ends = lambda hops: rows(g.cypher(f"MATCH (a:N {{name:'A'}})-[:NEXT*{hops}]->(b) RETURN b.name AS b"))
    assert ends("1..1") == [("B",)] and ends("1..2") == [("B",), ("C",)] and ends("1..3") == [("B",), ("C",), ("D",)]
    assert ends("2..3") == [("C",), ("D",)] and ends("2") == [("C",)] and ends("") == ends("1..3") and ends("0..1") == [("B",)]
    assert rows(g.cypher("MATCH (a)<-[:NEXT*2..5]-(b {name:'A'}) RETURN DISTINCT a.name AS a")) == [("C",), ("D",)]


def test_variable_length_does_not_come_back(g):
    g.cypher("CREATE (a:L {n:'A'}), (b:L {n:'B'}), (a)-[:LINK]->(b), (b)-[:LINK]->(a)")
    assert rows(g.cypher("MATCH (a:L {n:'A'})-[:LINK*1..5]->(b) RETURN b.n AS b")) == [("B",)]
    assert rows(g.cypher("MATCH (a:L {n:'A'})-[:LINK*1..5]->(b) RETURN DISTINCT b.n AS b")) == [("B",)]


def test_paths_count_one_by_one(g):
    g.cypher("CREATE (a:D {n:1}), (b:D {n:2}), (c:D {n:3}), (d:D {n:4}), (a)-[:E]->(b), (a)-[:E]->(c), (b)-[:E]->(d), (c)-[:E]->(d)")
    assert one(g.cypher("MATCH (a:D {n:1})-[:E*]->(d:D {n:4}) RETURN count(*) AS c")) == (2,)


def test_self_loop_both_ways_counts_twice(g):
    g.cypher("CREATE (a:S {n:1}) CREATE (a)-[:E]->(a)")
    assert g.cypher("MATCH (a:S)-[:E]-(b) RETURN a.n").count() == 2


def test_aggregates(g):
    g.cypher("CREATE (:Score {val:10}), (:Score {val:20}), (:Score {val:30}), (:Score {other:1})")
    assert one(g.cypher("MATCH (s:Score) RETURN sum(s.val) AS s, avg(s.val) AS a, min(s.val) AS lo, max(s.val) AS hi, count(s.val) AS n, count(*) AS c")) == (60, 20.0, 10, 30, 3, 4)
    assert sorted(map(str, one(g.cypher("MATCH (s:Score) RETURN collect(s.val) AS l"))[0])) == ["10", "20", "30", "None"]
    assert one(g.cypher("MATCH (n:Absent) RETURN count(*) AS c, sum(n.x) AS s, avg(n.x) AS a")) == (0, 0, None)
    assert one(g.cypher("MATCH (s:Score) RETURN sum(s.val) / count(s.val) AS m, count(*) * 2 + 1 AS x")) == (20, 9)


def test_grouping_having_two_levels(g):
    g.cypher(PEOPLE)
    assert rows(g.cypher("MATCH (p:Person) RETURN p.dept AS d, count(*) AS n")) == [("Eng", 2), ("Mkt", 1)]
    assert rows(g.cypher("MATCH (p:Person) WITH p.dept AS d, count(*) AS n WHERE n > 1 RETURN d")) == [("Eng",)]
    assert rows(g.cypher("MATCH (p:Person) WITH p.dept AS d, count(*) AS n RETURN n, count(*) AS k")) == [(1, 1), (2, 1)]
    assert rows(g.cypher("MATCH (p:Person) WITH p, p.age AS a ORDER BY a DESC RETURN collect(p.name) AS l")) == [(["Carol", "Alice", "Bob"],)]
    assert rows(g.cypher("MATCH (p:Person) RETURN p.missing AS m, count(*) AS n")) == [(None, 3)]


def test_distinct_skip_and_clause_order(g):
    g.cypher("UNWIND [0,1,2,3,4] AS v CREATE (:Item {val: v, cat: v / 3})")
    assert rows(g.cypher("MATCH (i:Item) RETURN DISTINCT i.cat AS c")) == [(0,), (1,)]
    assert [r[0] for r in g.cypher("MATCH (i:Item) RETURN i.val AS v ORDER BY v SKIP 2 LIMIT 2").collect()] == [2, 3]
    assert [r[0] for r in g.cypher("MATCH (i:Item) RETURN i.val AS v ORDER BY v LIMIT 3 SKIP 1").collect()] == [1, 2]
    assert g.cypher("MATCH (i:Item) RETURN i.val AS v LIMIT -1").count() == 5
    with pytest.raises(CypherTypeError):
        g.cypher("MATCH (i:Item) RETURN i.val AS v LIMIT $n", {"n": "x"})


def test_entities_have_an_identity(g):
    g.cypher(KNOWS)
    assert g.cypher("MATCH (a)-[:KNOWS]->(b) RETURN DISTINCT a").count() == 1
    assert one(g.cypher("MATCH (a)-[:KNOWS]->(b) RETURN count(DISTINCT a) AS c")) == (1,)
    assert one(g.cypher("MATCH (a:Person), (b:Person) WHERE a = b RETURN count(*) AS c")) == (3,)
    assert one(g.cypher("MATCH (a:Person {name:'Bob'}) RETURN a"))[0]["properties"]["age"] == 25


def test_multi_labels(g):
    g.cypher("CREATE (:Function:Public {name:'main'}), (:Function:Private {name:'helper'})")
    count = lambda labels: one(g.cypher(f"MATCH (n{labels}) RETURN count(*) AS c"))[0]
    assert [count(x) for x in (":Function", ":Public", ":Function:Public", ":Public:Private", "")] == [2, 1, 1, 0, 2]
    assert rows(g.cypher("MATCH (n:Public) RETURN labels(n) AS l")) == [(["Function", "Public"],)]


def test_two_valued_logic(g):
    g.cypher("CREATE (:V {a:1}), (:V {a:2, b:2}), (:V {b:5})")
    count = lambda cond: one(g.cypher(f"MATCH (n:V) WHERE {cond} RETURN count(*) AS c"))[0]
    assert count("n.a = null") == 1 and count("n.a <> 1") == 2 and count("NOT n.a > 1") == 2
    assert count("n.a = n.b") == 1 and count("n.a = n.nothing") == 1 and count("n.none = null") == 3
    assert count("n.a = 'x'") == 0 and count("n.a <> 'x'") == 3 and count("n.a < 'x'") == 0
    assert count("n.a = 1.0") == 1 and count("n.a IN [1, null]") == 2 and count("n.a IN 5") == 0
    assert count("n.a") == 2 and count("''") == 0 and count("0.0") == 3 and count("NOT null") == 3 and count("[]") == 3


def test_arithmetic(g):
    x = lambda e: one(g.cypher(f"RETURN {e} AS x"))[0]
    assert x("-7 / 2") == -3 and x("-7 % 2") == -1 and x("7 / 0") is None and x("7 % 0") is None
    assert x("1.0 / 0") == math.inf and x("-1 / 0.0") == -math.inf and math.isnan(x("0.0 / 0.0")) and x("7 / 2.0") == 3.5
    assert x("'a' + 'b'") == "ab" and x("'a' + 1") is None and x("1 + 2 * 3 - 4") == 3 and x("2 - (1)") == 1


def test_functions(g):
    x = lambda e: one(g.cypher(f"RETURN {e} AS x"))[0]
    assert x("toInteger('42')") == 42 and x("toInteger(3.9)") == 3 and x("toInteger(-3.9)") == -3 and x("TOINTEGER(true)") is None
    assert x("toString(30.0)") == "30" and x("toString(2.5)") == "2.5" and x("toString(null)") == "null" and x("toString(true)") == "true"
    with pytest.raises(PySparkException):
        x("toInteger('3.7')")
    for bad in ("nope(1)", "toInteger(1, 2)", "missing"):
        with pytest.raises(CypherTypeError):
            x(bad)
    assert x("$absent") is None


def test_case_and_strings(g):
    x = lambda e: one(g.cypher(f"RETURN {e} AS x"))[0]
    assert x("CASE WHEN 1 > 2 THEN 'a' WHEN true THEN 'b' ELSE 'c' END") == "b" and x("CASE 1 WHEN 2 THEN 'x' END") is None
    assert x("CASE null WHEN null THEN 'same' END") == "same" and x("CASE WHEN true THEN 1 ELSE 2.5 END") == 1.0
    assert x("'hello' CONTAINS 'ell'") and x("'hello' STARTS WITH 'he'") and x("'hello' ENDS WITH 'lo'") and x("1 CONTAINS 'x'") is False
    with pytest.raises(CypherTypeError):
        x("CASE WHEN true THEN 1 ELSE 'x' END")


def test_unwind(g):
    assert rows(g.cypher("UNWIND [1,2,3] AS x RETURN x")) == [(1,), (2,), (3,)]
    assert g.cypher("UNWIND [] AS x RETURN x").count() == 0 and rows(g.cypher("UNWIND null AS x RETURN x")) == [(None,)]
    assert rows(g.cypher("UNWIND 5 AS x RETURN x")) == [(5,)] and g.cypher("UNWIND [1,null] AS x RETURN x").count() == 2
    assert rows(g.cypher("UNWIND [1,2] AS x UNWIND [x, x * 10] AS y RETURN x, y")) == [(1, 1), (1, 10), (2, 2), (2, 20)]
    g.cypher("UNWIND $names AS n CREATE (:P {name: n})", {"names": ["a", "b"]})
    assert rows(g.cypher("MATCH (p:P) RETURN p.name AS n")) == [("a",), ("b",)]


def test_comma_patterns_share_variables_and_empty_stays_empty(g):
    g.cypher(KNOWS)
    assert g.cypher("MATCH (a)-[:KNOWS]->(b), (a)-[:KNOWS]->(c) RETURN b.name, c.name").count() == 4
    assert g.cypher("MATCH (x:Nothing), (a:Person) RETURN a.name").count() == 0
    assert g.cypher("MATCH (x:Nothing) MATCH (a:Person) RETURN a.name").count() == 0
    assert g.cypher("MATCH (a:Person), (b:Person) WHERE a.age < b.age RETURN a.name").count() == 3


def test_output_names(g):
    assert g.cypher("RETURN 1 + 1, 2 + 2, 'x' AS `the x`").columns == ["expr", "expr_2", "the x"]
    assert g.cypher("MATCH (n) RETURN count(*), count(*) AS count ORDER BY count").columns == ["count(..)", "count"]


def test_set_remove(g):
    g.cypher(PEOPLE)
    g.cypher("MATCH (p:Person {name:'Bob'}) SET p.age = p.age + 1, p.nick = 'bobby'")
    assert rows(g.cypher("MATCH (p:Person) WHERE p.nick IS NOT NULL RETURN p.age AS a, p.nick AS n")) == [(26, "bobby")]
    g.cypher("MATCH (p:Person {name:'Bob'}) SET p.age = 2.5")
    assert sorted(r[0] for r in g.cypher("MATCH (p:Person) RETURN p.age AS a").collect()) == [2.5, 30.0, 35.0]
    g.cypher("MATCH (p:Person) REMOVE p.age")
    assert one(g.cypher("MATCH (p:Person) RETURN count(p.age) AS c")) == (0,)
    # bindings keep what they had
    assert rows(g.cypher("MATCH (p:Person {name:'Bob'}) SET p.name = 'Robert' RETURN p.name AS n")) == [("Bob",)]
    assert g.cypher("MATCH (p:Person {name:'Robert'}) RETURN p.name").count() == 1


def test_delete(g):
    g.cypher(KNOWS)
    with pytest.raises(NodeHasEdges):
        g.cypher("MATCH (a:Person {name:'Alice'}) DELETE a")
    g.cypher("MATCH (:Person)-[r:KNOWS {since:2020}]->(:Person) DELETE r")
    assert g.edge_count() == 1 and one(g.cypher("MATCH (p:Person) RETURN count(*) AS c")) == (3,)
    g.cypher("MATCH (a:Person {name:'Alice'}) DETACH DELETE a")
    assert g.edge_count() == 0 and rows(g.cypher("MATCH (p:Person) RETURN p.name AS n")) == [("Bob",), ("Carol",)]
    g.cypher("MATCH (p:Person {name:'Bob'}) DELETE p")
    assert g.graph_stats()["node_count"] == 1


def test_merge(g):
    g.cypher("MERGE (f:Function {name:'f'}) ON CREATE SET f.made = 1 ON MATCH SET f.calls = 1")
    assert rows(g.cypher("MATCH (f:Function) RETURN f.made AS m, f.calls AS c")) == [(1, None)]
    assert rows(g.cypher("MERGE (f:Function {name:'f'}) ON CREATE SET f.made = 2 ON MATCH SET f.calls = 1 RETURN f.made AS m, f.calls AS c")) == [(1, 1)]
    g.cypher("UNWIND ['g','g','h'] AS x MERGE (f:Function {name:x})")
    assert rows(g.cypher("MATCH (f:Function) RETURN f.name AS n")) == [("f",), ("g",), ("h",)]


def test_create_sees_itself_and_batches(g):
    assert rows(g.cypher("CREATE (a:T {v:1}) WITH a MATCH (b:T) RETURN b.v AS v")) == [(1,)]
    assert rows(g.cypher_batch(["CREATE (:T {v:$x})", "MATCH (t:T) RETURN t.v AS v", "CREATE (:T {v:9})"], {"x": 2})) == [(1,), (2,)]
    assert rows(g.cypher("CREATE (:U {v:1}); MATCH (u:U) RETURN u.v AS v")) == [(1,)]
    g.cypher("MATCH (t:T {v:1}), (u:U) CREATE (t)<-[:R {w: t.v + u.v}]-(u)")
    assert rows(g.cypher("MATCH (u:U)-[r:R]->(t:T) RETURN r.w AS w, t.v AS t, type(r) AS k")) == [(2, 1, "R")]


def test_rollback(g):
    g.cypher("CREATE (:X {v:1})")
    g.begin()
    g.cypher("MATCH (x:X) SET x.v = 5")
    g.rollback()
    assert rows(g.cypher("MATCH (x:X) RETURN x.v AS v")) == [(1,)]


def test_vectors(g):
    ai = g.create_node_with_vector(["Doc"], {"title": "AI", "topic": "tech"}, [1, 0, 0])
    g.create_node_with_vector(["Doc"], {"title": "ML", "topic": "tech"}, [0.9, 0.1, 0])
    g.create_node_with_vector(["Doc"], {"title": "Cooking", "topic": "food"}, [0, 0, 1])
    alice = g.create_node(["Person"], {"name": "Alice"})
    g.create_edge(alice, ai, "AUTHORED")
    q = {"q": [1.0, 0.0, 0.0]}
    assert rows(g.cypher("MATCH (d:Doc) WHERE vector_similarity(d.embedding, $q) > 0.5 RETURN d.title AS t", q)) == [("AI",), ("ML",)]
    assert [r[0] for r in g.cypher("CALL vector.nearest('embedding', $q, 2) YIELD node AS n, score AS s RETURN n.title AS t, s ORDER BY s DESC", q).collect()] == ["AI", "ML"]
    assert rows(g.cypher("CALL vector.nearest('embedding', $q, 1) YIELD node MATCH (p:Person)-[:AUTHORED]->(node) RETURN p.name AS p", q)) == [("Alice",)]
    got = {r["t"]: (r["s"], r["e"], r["p"]) for r in g.cypher("MATCH (d:Doc) RETURN d.title AS t, vector_similarity(d.e, [1.0]) AS s, vector_distance(d.e, $q) AS e, dot_product(d.e, $q) AS p", q).collect()}
    assert got["AI"] == (None, 0.0, 1.0) and got["Cooking"] == (None, math.sqrt(2), 0.0)
    assert one(g.cypher("RETURN vector_similarity([0.0, 0.0], [1.0, 0.0]) AS z, vector_similarity([1.0], [1.0, 2.0]) AS m, vector_distance([0, 3], [4, 0]) AS d")) == (0.0, None, 5.0)
    g.set_node_vector(ai, [0, 1, 0])
    assert g.get_node_vector(ai) == [0, 1, 0] and g.get_node_vector(alice) is None and g.has_vectors()
    assert g.all_node_vectors().count() == 3
    with pytest.raises(CypherTypeError):
        g.cypher("CALL vector.other('e', $q)", q)


def test_methods(g):
    a, b = g.create_nodes_batch([(["P"], {"n": 1}), (["P"], {"n": 2})])
    e = g.create_edge(a, b, "R", {"w": 1})
    assert json.loads(one(g.get_node(a))[2]) == {"n": 1} and g.get_node("none").count() == 0
    assert one(g.get_edge(e))[1:3] == (a, b) and g.neighbors(a).count() == 1 and g.neighbors(a, "X").count() == 0 and g.neighbors(b).count() == 0
    g.set_node_property(a, "n", 7)
    g.set_node_property(a, "tag", "x")
    assert rows(g.cypher("MATCH (p:P) WHERE p.tag = 'x' RETURN p.n AS n")) == [(7,)]
    with pytest.raises(NodeNotFound):
        g.create_edge(a, "none", "R")
    with pytest.raises(NodeHasEdges):
        g.delete_node(a)
    g.delete_edge(e)
    with pytest.raises(EdgeNotFound):
        g.delete_edge(e)
    g.delete_node(a)
    assert g.graph_stats() == {"node_count": 1, "edge_count": 0, "labels": ["P"], "relationship_types": ["R"], "has_vectors": False}
    g.create_property_index("P", "n")
    assert rows(g.cypher("MATCH (p:P {n:2}) RETURN p.n AS n")) == [(2,)] and ("P", "n") in g.reindex()


def test_json_round_trip(g, spark, tmp_path):
    graph = {"nodes": [{"id": "1", "labels": ["A"], "properties": {"x": 1, "l": [1, 2]}, "vector": [1.0, 2.0]}, {"id": "2", "labels": ["A"], "properties": {"x": 2}}, {"id": "3", "labels": ["B", "C"]}], "edges": [{"source": "1", "target": "2", "type": "R", "properties": {"w": 0.5}}, {"source": "2", "target": "3", "type": "S"}]}
    assert g.import_json(graph) == (3, 2)
    out = g.export_json()
    other = GraphEngine(spark)
    path = tmp_path / "g.json"
    path.write_text(json.dumps(out))
    assert other.import_json(str(path)) == (3, 2)
    assert rows(other.cypher("MATCH (a:A)-[r:R]->(b:A) RETURN a.x AS a, b.x AS b, r.w AS w")) == [(1, 2, 0.5)]
    assert other.all_node_vectors().count() == 1
    with pytest.raises(GraphError):
        g.import_json({"nodes": [], "edges": [{"source": "1", "target": "2", "type": "R"}]})


def test_raw_vectors(g):
    g.insert_vector("a", [1, 0], {"k": 1})
    g.insert_vector("b", [0, 1])
    g.insert_vector("c", [1, 1, 1])
    assert [r["id"] for r in g.query_vectors([1, 0.1], 2).collect()] == ["a", "b"] and g.get_vector("b") == [0, 1] and g.get_vector("x") is None


def test_type_conflicts_fall_back_to_strings(g):
    g.cypher("CREATE (:M {v:1})")
    g.cypher("CREATE (:M {v:'x'})")
    assert rows(g.cypher("MATCH (m:M) RETURN m.v AS v")) == [("1",), ("x",)]


def test_a_variable_length_variable_cannot_be_used(g):
    g.cypher(KNOWS)
    with pytest.raises(CypherTypeError):
        g.cypher("MATCH (a)-[r:KNOWS*1..2]->(b) RETURN type(r) AS t")


@pytest.mark.parametrize("seed", [1, 2])
def test_variable_length_on_random_graphs(spark, seed):
    import random

    r = random.Random(seed)
    edges = {(r.randrange(8), r.randrange(8)) for _ in range(14)}
    engine = GraphEngine(spark)
    ids = engine.create_nodes_batch([(["R"], {"n": i}) for i in range(8)])
    engine.create_edges_batch([(ids[a], ids[b], "E", {}) for a, b in sorted(edges)])

    def paths(at, seen, left):
        for a, b in edges:
            if a == at and b not in seen:
                yield seen[0], b, len(seen)
                if left > 1:
                    yield from paths(b, [*seen, b], left - 1)

    every = [p for s in range(8) for p in paths(s, [s], 5)]
    for least, most in ((1, 3), (2, 4), (1, 5)):
        want = sorted((a, b) for a, b, d in every if least <= d <= most)
        query = f"MATCH (a:R)-[:E*{least}..{most}]->(b:R) RETURN {{}}a.n AS a, b.n AS b"
        assert rows(engine.cypher(query.format(""))) == want
        assert rows(engine.cypher(query.format("DISTINCT "))) == sorted(set(want))


def test_properties_of_variable_length_edges_hold_for_each(spark):
    g = GraphEngine(spark)
    g.cypher("CREATE (:X {i:1})-[:R {w:1}]->(:X {i:2})-[:R {w:1}]->(:X {i:3})-[:R {w:2}]->(:X {i:4}), (:X {i:5})-[:S]->(:X {i:6})")
    found = lambda text, **p: sorted(tuple(r) for r in g.cypher(f"MATCH (a:X)-[{text}]->(b:X) RETURN a.i AS a, b.i AS b", p).collect())
    assert found(":R*1..3 {w:1}") == [(1, 2), (1, 3), (2, 3)] == found("*1..3 {w:$w}", w=1)
    assert found("*1..3 {w:2}") == [(3, 4)] and found("*1..3 {w:9}") == [] == found(":S*1..3 {w:1}")
    assert found("*1..3") == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)]


BRANCHES = [
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) RETURN n.name AS n, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N)<-[:IN]-(c:C) RETURN n.name AS n, count(s) AS s, count(c) AS c, count(DISTINCT s) AS d",
    "MATCH (s:S)-[:IN]->(n:N), (c:C)-[:IN]->(n) WHERE s.v > 1 RETURN n.name AS n, sum(s.v) AS a, sum(c.v) AS b, avg(s.v) AS e, min(c.v) AS lo, max(s.v) AS hi, count(s.v) AS k",
    "MATCH (s:S)-[l:IN]->(n:N) MATCH (c:C)-[m:IN]->(n) RETURN l.w AS w, sum(m.w) AS m, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) WITH n, count(*) AS c WHERE c > 2 RETURN n.name AS n, c",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) WHERE s.v = c.v RETURN n.name AS n, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C {v: s.v})-[:IN]->(n) MATCH (d:C)-[:IN]->(n) RETURN count(*) AS c, sum(d.v) AS d",
    "MATCH (s:S)-[:IN]-(n)-[:IN]-(c)-[:IN]-(m) RETURN m.name AS m, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (n)<-[:IN*1..2]-(c) RETURN n.name AS n, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N) OPTIONAL MATCH (c:C {v: 2})-[:IN]->(n) RETURN n.name AS n, count(c) AS c",
    "MATCH (s:S), (c:C) WHERE s.v = c.v RETURN count(*) AS c",
    "MATCH (s:S), (c:C), (d:C) WHERE s.v = c.v AND c.v < d.v RETURN s.v AS v, count(*) AS c, sum(d.v) AS d",
    "MATCH (s:S), (c:C {v: s.v}) RETURN s.v AS v, count(c) AS c",
    "MATCH (c:C), (n:N) RETURN n.name AS n, count(*) AS c",
    "MATCH (c:C), (n:N)<-[:IN]-(s:S) RETURN n.name AS n, count(c) AS c",
    "MATCH (a:Absent), (n:N) RETURN n.name AS n, count(*) AS c",
    "MATCH (a:Absent), (n:N) RETURN count(*) AS c, sum(n.v) AS s, avg(n.v) AS a",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) RETURN s, count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) RETURN id(s) AS s, labels(n) AS l, count(*) AS c",
    "UNWIND [1, 2, 2] AS x MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) WHERE c.v = x RETURN x, count(*) AS c",
    "UNWIND [1, 2, 2] AS x MATCH (s:S)-[:IN]->(n:N)<-[:IN]-(c:C) RETURN count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N)<-[:IN]-(c:C) WHERE NOT s.v IS NULL RETURN DISTINCT count(*) AS c",
    "MATCH (s:S)-[:IN]->(n:N)<-[:IN]-(c:C) RETURN collect(s.v) AS l",
]


def test_gathered_rows_count_as_often_as_they_come(spark, g, monkeypatch):
    """Every statement against the plan that joins row by row, on nodes with equal and missing values and on parallel edges."""
    from sparkloom.plans import execute

    g.cypher("CREATE (:N {name:'a', v:1}), (:N {name:'b', v:2}), (:N {name:'b', v:2}), (:N {v:3})")
    g.cypher("UNWIND [1,2,2,3,3,3] AS v CREATE (:S {v: v})")
    g.cypher("UNWIND [1,1,2,2,4] AS v CREATE (:C {v: v})")
    g.cypher("CREATE (:S {other: 1}), (:C {other: 1})")
    for text in ("(s:S), (n:N) WHERE s.v >= n.v CREATE (s)-[:IN {w: s.v}]->(n)", "(s:S), (n:N) WHERE s.v = n.v CREATE (s)-[:IN {w: 7}]->(n)", "(c:C), (n:N) WHERE c.v <> n.v CREATE (c)-[:IN {w: c.v}]->(n)", "(c:C {other: 1}), (n:N) CREATE (c)-[:IN]->(n)"):
        g.cypher(f"MATCH {text}")
    found = lambda: [sorted(map(repr, g.cypher(text).collect())) if "collect" not in text else sorted(map(str, one(g.cypher(text))[0])) for text in BRANCHES]
    gathered = found()
    monkeypatch.setattr(execute, "counted_uses", lambda *_: None)
    for text, a, b in zip(BRANCHES, gathered, found(), strict=True):
        assert a == b, text


def test_branches_that_meet_are_counted_before_they_join(spark, g):
    """300 x 300 pairs at one node: no join gives more rows than there are edges."""
    g.cypher("CREATE (:N {name:'x'})")
    for label in ("S", "C"):
        g.cypher(f"UNWIND $v AS v CREATE (:{label} {{v: v, k: 1}})", {"v": list(range(300))})
        g.cypher(f"MATCH (s:{label}), (n:N) CREATE (s)-[:IN]->(n)")
    for text in ("MATCH (s:S)-[:IN]->(n:N) MATCH (c:C)-[:IN]->(n) RETURN n.name AS n, count(*) AS c", "MATCH (s:S)-[:IN]->(n:N)<-[:IN]-(c:C) RETURN n.name AS n, count(s) AS c", "MATCH (s:S), (c:C) WHERE s.k = c.k RETURN 'x' AS n, count(*) AS c"):
        df = g.cypher(text)
        assert rows(df) == [("x", 90_000)]
        assert most_joined(df) <= 600, text


def most_joined(df):
    """The most rows that a join of an executed plan gave."""
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if "Join" in name or "CartesianProduct" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return most
