"""The registered queries: statements of the query language over the table graph, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import GraphEngine
from .errors import GraphError
from .functions import vectors
from .operators.ivf import DIGITS, VectorIndex
from .operators.knn import nearest_of_all, nearest_to_each
from .oracle import ORACLE
from .sources import results
from .sources.scratch import new_path
from .sources.tables import TableGraph
from .sources.vector_store import VectorStore

_graphs: dict[tuple, TableGraph] = {}


def graph_of(spark: SparkSession, folder: str) -> TableGraph:
    """The table graph of a folder; the last one is kept, so that schemas are read once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = TableGraph(spark, folder)
    return _graphs[key]


@dataclass(frozen=True)
class Spec:
    """A query: its text, the labels and edge types of the graph it runs on, and what is done with its result."""

    labels: str
    kinds: str
    text: str
    params: dict[str, Any] | None = None
    query_vector: bool = False  # $q is the vector of vec_id 0
    after: Callable[[DataFrame], DataFrame] | None = None

    def engine(self, spark: SparkSession, folder: str) -> GraphEngine:
        g = graph_of(spark, folder)
        out = g.catalog(self.labels.split(), self.kinds.split() or ["IN_REGION"])
        return GraphEngine(spark, out if self.kinds else replace(out, edges=()))

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        params = dict(self.params or {})
        if self.query_vector:
            params["q"] = query_vector(spark, folder)
        df = self.engine(spark, folder).cypher(self.text, params)
        return self.after(df) if self.after else df


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    rows = graph_of(spark, folder).table("embeddings").where("vec_id = 0").select("embedding").take(1)
    return [float(x) for x in rows[0][0]] if rows else []


def _rounded(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, 6) for n in names})


def _joined(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.array_join(n, ",") for n in names})


URGENT = "{o_orderpriority:'1-URGENT', o_orderstatus:'F'}"

SPECS: dict[str, Spec] = {
    # scans, seeks, filters
    "scan_label": Spec("Nation", "", "MATCH (n:Nation) RETURN n.n_name AS name"),
    "scan_all_count": Spec("Region Nation", "", "MATCH (n) RETURN count(*) AS c"),
    "seek_param": Spec("Customer", "", "MATCH (c:Customer) WHERE c.c_custkey = $k RETURN c.c_name AS name", {"k": 42}),
    "seek_id": Spec("Customer", "", "MATCH (c:Customer) WHERE id(c) = 'Customer:42' RETURN c.c_name AS name"),
    "inline_props": Spec("Customer", "", "MATCH (c:Customer {c_mktsegment:'BUILDING'}) RETURN c.c_custkey AS k"),
    "filter_compare": Spec("Customer", "", "MATCH (c:Customer) WHERE c.c_acctbal >= 9000 AND c.c_mktsegment <> 'BUILDING' RETURN c.c_custkey AS k, c.c_acctbal AS bal"),
    "filter_or_not": Spec("Order", "", "MATCH (o:Order) WHERE NOT (o.o_orderstatus='F' OR o.o_totalprice < 400000) RETURN o.o_orderkey AS k"),
    "filter_in": Spec("Part", "", "MATCH (p:Part) WHERE p.p_type IN ['PROMO','SMALL'] RETURN p.p_partkey AS k, p.p_type AS t"),
    "filter_contains": Spec("Part", "", "MATCH (p:Part) WHERE p.p_name CONTAINS 'ring' RETURN p.p_partkey AS k"),
    "filter_starts_ends": Spec("Part", "", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'red' OR p.p_name ENDS WITH 'widget' RETURN p.p_partkey AS k"),
    "two_valued_null": Spec("Customer Order", "PLACED", f"MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {URGENT}) WITH c, o.o_totalprice AS p WHERE NOT p > 100000 RETURN c.c_custkey AS k, p"),
    # expressions
    "arith_int": Spec("Part", "", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS d, p.p_size % 7 AS m, p.p_size * 2 - 3 AS x"),
    "arith_div_zero": Spec("Part", "", "MATCH (p:Part) RETURN p.p_partkey AS k, 100 / (p.p_size % 5) AS d"),
    "concat_plus": Spec("Nation", "", "MATCH (n:Nation) RETURN n.n_name + '!' AS s"),
    "case_searched": Spec("Part", "", "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'low' WHEN p.p_size < 30 THEN 'mid' ELSE 'high' END AS tier, count(*) AS c"),
    "case_simple": Spec("Order", "", "MATCH (o:Order) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS s"),
    "to_integer_string": Spec("Customer", "", "MATCH (c:Customer) RETURN toInteger(c.c_acctbal) AS i, toString(c.c_custkey) AS s"),
    "quoted_names": Spec("Region", "", "MATCH (`my node`:Region) RETURN `my node`.`r_name` AS `match`"),
    "labels_fn": Spec("Nation", "", "MATCH (n:Nation) RETURN DISTINCT labels(n) AS l", after=_joined("l")),
    "list_map_literals": Spec("Region", "", "MATCH (r:Region) RETURN [r.r_regionkey, 7] AS l, {k: r.r_name}.k AS m", after=_joined("l")),
    "null_tests": Spec("Customer Order", "PLACED", f"MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {URGENT}) RETURN c.c_custkey AS k, o.o_orderkey IS NULL AS missing, o.nothing IS NOT NULL AS there"),
    # WITH, DISTINCT, UNWIND
    "with_chain": Spec("Part", "", "MATCH (p:Part) WITH p.p_type AS t, p.p_retailprice AS r WHERE r > 950 RETURN t, max(r) AS m"),
    "distinct_values": Spec("Part", "", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_type AS t"),
    "distinct_nodes": Spec("Customer Order", "PLACED", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 WITH DISTINCT c RETURN c.c_custkey AS k"),
    "unwind_literal": Spec("Region", "", "UNWIND [1,2,3] AS x RETURN x"),
    "unwind_scalar": Spec("Region", "", "UNWIND 5 AS x UNWIND null AS y RETURN x, y IS NULL AS y"),
    "unwind_after_rows": Spec("Region", "", "MATCH (r:Region) UNWIND [1,2] AS x RETURN r.r_name AS n, x"),
    "unwind_join": Spec("Part", "", "UNWIND ['PROMO','SMALL'] AS t MATCH (p:Part) WHERE p.p_type = t RETURN t, count(*) AS c"),
    # one hop and more
    "expand_out": Spec("Customer Order", "PLACED", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 RETURN c.c_name AS name, o.o_orderkey AS k"),
    "expand_in": Spec("Customer Order", "PLACED", "MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN o.o_orderkey AS k, c.c_custkey AS c"),
    "expand_both": Spec("Region Nation", "IN_REGION", "MATCH (n:Nation)-[:IN_REGION]-(r:Region) RETURN n.n_name AS n, r.r_name AS r"),
    "expand_both_homog": Spec("Vec", "CALLS", "MATCH (a:Vec)-[:CALLS]-(b:Vec) RETURN a.vec_id AS a, b.vec_id AS b"),
    "expand_into": Spec(
        "Customer Order Part Supplier Nation",
        "PLACED CONTAINS SUPPLIES IN_NATION",
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part), (s:Supplier)-[:SUPPLIES]->(p), (c)-[:IN_NATION]->(n:Nation), (s)-[:IN_NATION]->(n) WHERE o.o_totalprice > 480000 RETURN n.n_name AS n, count(*) AS c",
    ),
    "expand_multi_type": Spec("Vec", "CALLS IMPORTS REFERENCES", "MATCH (a:Vec)-[:CALLS:IMPORTS]->(b:Vec) RETURN a.vec_id AS a, b.vec_id AS b"),
    "expand_any_type": Spec("Vec", "CALLS IMPORTS REFERENCES", "MATCH (a:Vec)-[r]->(b:Vec) RETURN type(r) AS t, count(*) AS c"),
    "rel_property": Spec("Order Part", "CONTAINS", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 48 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q"),
    "rel_inline_props": Spec("Order Part", "CONTAINS", "MATCH (o:Order)-[l:CONTAINS {l_returnflag:'R'}]->(p:Part {p_type:'PROMO'}) RETURN o.o_orderkey AS o, p.p_partkey AS p"),
    "multi_hop": Spec("Customer Nation Region", "IN_NATION IN_REGION", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS c"),
    "four_hop_revenue": Spec(
        "Region Nation Customer Order Part",
        "IN_REGION IN_NATION PLACED CONTAINS",
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) RETURN r.r_name AS r, sum(l.l_quantity) AS q",
    ),
    "neighbor_degrees": Spec("Order Part", "CONTAINS", "MATCH (o:Order)-[:CONTAINS]->(p) WITH o, count(p) AS n WHERE n >= 9 RETURN id(o) AS o, n"),
    # variable length
    "varlen_1_3": Spec("Vec", "CALLS", "MATCH (a:Vec)-[:CALLS*1..3]->(b:Vec) RETURN a.vec_id AS a, b.vec_id AS b"),
    "varlen_exact_2": Spec("Vec", "CALLS", "MATCH (a:Vec)-[:CALLS*2]->(b:Vec) RETURN a.vec_id AS a, b.vec_id AS b"),
    "varlen_2_4": Spec("Vec", "CALLS REFERENCES", "MATCH (a:Vec)-[:CALLS:REFERENCES*2..4]->(b:Vec) RETURN a.vec_id AS a, count(*) AS paths"),
    "varlen_distinct": Spec("Vec", "CALLS IMPORTS", "MATCH (a:Vec)-[:CALLS:IMPORTS*1..4]->(b:Vec) RETURN DISTINCT a.vec_id AS a, b.vec_id AS b"),
    "varlen_distinct_where": Spec("Vec", "CALLS IMPORTS", "MATCH (a:Vec)-[:CALLS:IMPORTS*1..4]->(b:Vec) WHERE a.label = 3 RETURN DISTINCT a.vec_id AS a, b.vec_id AS b"),
    "varlen_edge_props": Spec("Order Part", "CONTAINS", "MATCH (o:Order)-[:CONTAINS*1..2 {l_returnflag:'R'}]->(p:Part) RETURN o.o_orderkey AS o, count(*) AS n"),
    "varlen_chain_default_cap": Spec("Turn", "NEXT", "MATCH (a:Turn)-[:NEXT*]->(b:Turn) RETURN a.conv_id AS c, count(*) AS n"),
    # products, theta joins, correlated and optional patterns
    "cartesian": Spec("Region", "", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b"),
    "comma_equi_join": Spec("Customer Supplier", "", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN count(*) AS n"),
    "theta_join": Spec("Supplier", "", "MATCH (a:Supplier), (b:Supplier) WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal RETURN a.s_suppkey AS a, b.s_suppkey AS b"),
    "correlated_match": Spec("Supplier Customer Nation", "IN_NATION", "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.n_name AS n, count(*) AS pairs"),
    "optional_match": Spec("Customer Order", "PLACED", f"MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {URGENT}) RETURN c.c_custkey AS k, count(o) AS n"),
    "optional_anti": Spec("Customer Order", "PLACED", f"MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {URGENT}) WITH c, o WHERE o IS NULL RETURN c.c_custkey AS k"),
    # aggregation
    "count_variants": Spec("Order", "", "MATCH (o:Order) RETURN count(*) AS n, count(o.o_orderstatus) AS s, count(DISTINCT o.o_custkey) AS d"),
    "sum_avg_min_max": Spec("Part", "", "MATCH (p:Part) RETURN sum(p.p_size) AS s, avg(p.p_size) AS a, min(p.p_size) AS lo, max(p.p_name) AS hi"),
    "sum_empty": Spec("Part", "", "MATCH (p:Part) WHERE p.p_size > 999 RETURN count(*) AS c, sum(p.p_size) AS s, avg(p.p_size) AS a"),
    "group_by": Spec("Order", "", "MATCH (o:Order) RETURN o.o_orderstatus AS s, o.o_orderpriority AS p, count(*) AS c"),
    "collect_size_order": Spec("Region Nation", "IN_REGION", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n.n_name AS x ORDER BY x RETURN r.r_name AS r, collect(x) AS names", after=_joined("names")),
    "having": Spec("Customer Order", "PLACED", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 17 RETURN c.c_custkey AS k, n"),
    "two_level_agg": Spec("Customer Order", "PLACED", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n RETURN n, count(*) AS customers"),
    "agg_in_expr": Spec("Order", "", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) + 1 AS c"),
    # sort and paging
    "order_limit_skip": Spec("Order", "", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10"),
    "limit_then_skip": Spec("Order", "", "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY k LIMIT 10 SKIP 5"),
    "order_nonprojected": Spec("Customer", "", "MATCH (c:Customer) RETURN c.c_name AS n ORDER BY c.c_acctbal DESC, n LIMIT 7"),
    # vectors
    "vec_similarity": Spec("Vec", "", "MATCH (e:Vec) RETURN e.vec_id AS id, vector_similarity(e.embedding,$q) AS s", query_vector=True, after=_rounded("s")),
    "vec_distance": Spec("Vec", "", "MATCH (e:Vec) RETURN e.vec_id AS id, vector_distance(e.embedding,$q) AS d", query_vector=True, after=_rounded("d")),
    "vec_dot": Spec("Vec", "", "MATCH (e:Vec) RETURN e.vec_id AS id, dot_product(e.embedding,$q) AS d", query_vector=True, after=_rounded("d")),
    "vec_filter": Spec("Vec", "", "MATCH (e:Vec) WHERE vector_similarity(e.embedding,$q) > 0.2 RETURN e.vec_id AS id", query_vector=True),
    "knn_call": Spec("Vec", "", "CALL vector.nearest('embedding',$q,10) YIELD node, score RETURN node.vec_id AS id, score", query_vector=True, after=_rounded("score")),
    "knn_approximate": Spec("Vec", "", "CALL vector.approximate('embedding',$q,1) YIELD node, score RETURN node.vec_id AS id, score", query_vector=True, after=_rounded("score")),
    "knn_traverse": Spec("Vec", "CALLS", "CALL vector.nearest('embedding',$q,10) YIELD node MATCH (a:Vec)-[:CALLS]->(node) RETURN a.vec_id AS a, node.vec_id AS n", query_vector=True),
    "hybrid_rank": Spec("Vec", "REFERENCES", "MATCH (a:Vec)-[:REFERENCES]->(b:Vec) WHERE a.label = 3 RETURN b.vec_id AS id, vector_similarity(b.embedding,$q) AS s ORDER BY s DESC, id LIMIT 5", query_vector=True, after=_rounded("s")),
    # changes
    "create_edges_query": Spec("Region", "", "MATCH (a:Region),(b:Region) WHERE a.r_regionkey<b.r_regionkey CREATE (a)-[:NEAR]->(b); MATCH (:Region)-[:NEAR]->(:Region) RETURN count(*) AS c"),
    "multi_label_and": Spec("Nation", "", "MATCH (n:Nation) WHERE n.n_regionkey <= 2 CREATE (m:Copy:Best {name: n.n_name}); MATCH (n:Nation) WHERE n.n_regionkey > 2 CREATE (m:Copy {name: n.n_name}); MATCH (m:Best:Copy) RETURN m.name AS name"),
    "create_nodes_query": Spec("Nation", "", "MATCH (n:Nation) WHERE n.n_regionkey = 2 CREATE (m:Copy {name: n.n_name, key: n.n_nationkey}); MATCH (m:Copy) RETURN m.name AS name, m.key AS key"),
    "set_property": Spec("Customer", "", "MATCH (c:Customer) WHERE c.c_acctbal<0 SET c.flag='neg'; MATCH (c:Customer) RETURN c.flag AS f, count(*) AS c"),
    "remove_property": Spec("Nation", "", "MATCH (n:Nation) WHERE n.n_regionkey=1 REMOVE n.n_name; MATCH (n:Nation) RETURN count(n.n_name) AS c"),
    "detach_delete": Spec("Customer Order", "PLACED", "MATCH (c:Customer) WHERE c.c_mktsegment='BUILDING' DETACH DELETE c; MATCH (:Customer)-[:PLACED]->(o) RETURN count(*) AS c"),
    "delete_node": Spec("Region Nation", "", "MATCH (n:Nation) WHERE n.n_regionkey=3 DELETE n; MATCH (n:Nation) RETURN n.n_name AS name"),
    "delete_edge": Spec("Order Part", "CONTAINS", "MATCH (:Order)-[l:CONTAINS]->(:Part) WHERE l.l_quantity<25 DELETE l; MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN count(*) AS c"),
    "merge_upsert": Spec("Nation", "", "UNWIND ['NATION_1','ATLANTIS'] AS x MERGE (n:Nation {n_name:x}) ON CREATE SET n.isnew=1 ON MATCH SET n.isnew=0; MATCH (n:Nation) RETURN n.isnew AS f, count(*) AS c"),
}


def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest of each vector whose vec_id is divisible by 50, among all, itself left out."""
    vecs = graph_of(spark, folder).table("embeddings")
    base = vecs.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    return nearest_to_each(base, asked, 3, digits=6).select("q", "id", F.col("rk").cast("long").alias("rk"))


def knn_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index over all vectors, asked for the ten nearest of each vector whose vec_id is divisible by 50: whether nine in ten of the true ones are found."""
    vecs = graph_of(spark, folder).table("embeddings")
    base = vecs.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    index = VectorIndex.build(base)
    if index is None:
        return spark.createDataFrame([], "queries long, asked long, enough boolean")
    found = index.search_each(asked, 10).select("q", "id", F.lit(1).alias("hit"))
    true = nearest_to_each(base, asked, 10, digits=DIGITS).select("q", "id")
    return true.join(found, ["q", "id"], "left").agg(F.countDistinct("q").alias("queries"), F.count("*").alias("asked"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def knn_all(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest of every vector, itself left out."""
    vecs = graph_of(spark, folder).table("embeddings")
    base = vecs.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest_of_all(base, 3, digits=6).select("q", "id", F.col("rk").cast("long").alias("rk"))


def vec_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Norms of the vectors, and of their normalized forms."""
    vec = F.col("embedding")
    return graph_of(spark, folder).table("embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.norm(vec), 6).alias("n"), F.round(vectors.norm(vectors.normalized(vec)), 6).alias("u"))


def vec_metric_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Euclidean distance to vector 0 as a similarity."""
    q = F.array(*[F.lit(x) for x in query_vector(spark, folder)])
    return graph_of(spark, folder).table("embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.similarity("euclidean", F.col("embedding"), q), 6).alias("s"))


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    labels = ["Customer", "Order", "Part", "Supplier", "Nation", "Region"]
    return GraphEngine(spark, replace(graph_of(spark, folder).catalog(labels, ["IN_REGION"]), edges=())).label_counts()


def edge_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["IN_REGION", "IN_NATION", "PLACED", "CONTAINS"]
    return GraphEngine(spark, graph_of(spark, folder).catalog(["Nation"], kinds)).type_counts()


def _store(spark: SparkSession, folder: str) -> VectorStore:
    vecs = graph_of(spark, folder).table("embeddings")
    items = vecs.select(F.format_string("%010d", "vec_id").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("vec_id", "label")).alias("metadata"))
    return VectorStore.over(spark, items)


def items_list_page(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).list_items(limit=20, offset=40).select(F.col("id").cast("long").alias("id"))


def items_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).get_stats().select("items", F.col("dimensions").cast("long").alias("dimensions"))


def items_query(spark: SparkSession, folder: str) -> DataFrame:
    found = _store(spark, folder).query_items(query_vector(spark, folder), 10)
    return found.select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


# --------------------------------------------------------------------------- methods of the engine


def _engine(spark: SparkSession, folder: str, labels: str, kinds: str = "") -> GraphEngine:
    return Spec(labels, kinds, "").engine(spark, folder)


def seek_edge(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder, "Nation Region", "IN_REGION").get_edge("IN_REGION:Nation:5").select("id", "source", "target", "type")


def index_seek(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup in tables that a property index has clustered."""
    g = _engine(spark, folder, "Order")
    g.create_property_index("Order", "o_custkey")
    return g.cypher("MATCH (o:Order {o_custkey:7}) RETURN o.o_orderkey AS k, o.o_totalprice AS p")


def all_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = _engine(spark, folder, "Vec").all_node_vectors()
    return found.select("id", F.size("vector").cast("long").alias("n"), F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("x"))


def set_vector(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors after one was set, and that one as it is read back."""
    g = _engine(spark, folder, "Vec")
    size = len(query_vector(spark, folder))
    g.set_node_vector("Vec:0", [2.0] * size)
    back = sum(g.get_node_vector("Vec:0") or [])
    return g.all_node_vectors().select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("x"), F.lit(back == 2.0 * size).alias("same"))


def catalog_names(spark: SparkSession, folder: str) -> DataFrame:
    g = _engine(spark, folder, "Nation Region Customer", "IN_REGION IN_NATION")
    return spark.createDataFrame([("label", x) for x in g.labels()] + [("type", x) for x in g.relationship_types()], "kind string, name string")


def derived_names(spark: SparkSession, folder: str) -> DataFrame:
    """Column names of a result without aliases."""
    df = _engine(spark, folder, "Nation").cypher("MATCH (n:Nation) RETURN n.n_name, id(n), n.n_nationkey + 1, n.n_regionkey AS r")
    return spark.createDataFrame(list(enumerate(df.columns)), "place long, name string")


def count_outside(spark: SparkSession, folder: str) -> DataFrame:
    """count() in a WHERE has no group to count: it is refused."""
    try:
        _engine(spark, folder, "Nation").cypher("MATCH (n:Nation) WHERE count(n) > 1 RETURN n.n_name AS name")
    except GraphError:
        return spark.createDataFrame([(True,)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


def neighbors_of(spark: SparkSession, folder: str) -> DataFrame:
    return _engine(spark, folder, "Order Part", "CONTAINS").neighbors("Order:1", "CONTAINS").select("id")


def batch_create(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges created from DataFrames, and a hop over them."""
    g, t = GraphEngine(spark), graph_of(spark, folder)
    g.create_nodes_from(["Client"], t.table("customer").select(F.format_string("c%d", "c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    g.create_nodes_from(["Sale"], t.table("orders").select(F.format_string("o%d", "o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), "id")
    g.create_edges_from("BOUGHT", t.table("orders").select(F.format_string("c%d", "o_custkey").alias("c"), F.format_string("o%d", "o_orderkey").alias("o")), "c", "o")
    return g.cypher("MATCH (c:Client)-[:BOUGHT]->(o:Sale) RETURN c.name AS name, count(*) AS n, max(o.price) AS top")


def batch_create_lists(spark: SparkSession, folder: str) -> DataFrame:
    g = GraphEngine(spark)
    ids = g.create_nodes_batch([(["P"], {"k": i}) for i in range(5)])
    g.create_edges_batch([(ids[i], ids[i + 1], "NEXT", {"w": i}) for i in range(4)])
    return g.cypher("MATCH (a:P)-[e:NEXT]->(b:P) RETURN a.k AS a, e.w AS w, b.k AS b")


def create_with_vector(spark: SparkSession, folder: str) -> DataFrame:
    """A node created with a vector is the nearest to it."""
    g, q = _engine(spark, folder, "Vec"), query_vector(spark, folder)
    q = [-x for x in q]
    g.create_node_with_vector(["Probe"], {"name": "new"}, q)
    return g.cypher("CALL vector.nearest('embedding',$q,1) YIELD node, score RETURN node.name AS name, score", {"q": q}).withColumn("score", F.round("score", 6))


def programmatic_changes(spark: SparkSession, folder: str) -> DataFrame:
    g = _engine(spark, folder, "Nation Region", "IN_REGION")
    g.set_node_property("Nation:1", "n_name", "CHANGED")
    g.delete_node("Nation:2", detach=True)
    g.delete_edge("IN_REGION:Nation:3")
    return g.cypher("MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


def statement_batch(spark: SparkSession, folder: str) -> DataFrame:
    g = _engine(spark, folder, "Nation")
    return g.cypher_batch(["MATCH (n:Nation) WHERE n.n_regionkey = $r SET n.flag = 1", "MATCH (n:Nation) WHERE n.flag = 1 RETURN n.n_name AS name"], {"r": 2})


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A graph exported as JSON lines and imported again, both by all executors."""
    path = new_path(spark, "graph")
    _engine(spark, folder, "Customer Supplier Nation", "IN_NATION").export_json_lines(path)
    g = GraphEngine(spark)
    g.import_json_lines(path)
    return g.cypher("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS n, count(*) AS c, sum(c.c_custkey) AS s")


def json_export(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that an export writes, read as JSON."""
    path = new_path(spark, "graph")
    _engine(spark, folder, "Customer", "").export_json_lines(path)
    lines = spark.read.json(f"{path}/nodes")
    return lines.select("id", F.array_join("labels", ",").alias("l"), F.col("properties.c_name").alias("name"), F.col("properties.c_mktsegment").alias("segment"))


def json_objects(spark: SparkSession, folder: str) -> DataFrame:
    """A graph that fits the driver as one object, exported and imported."""
    graph = _engine(spark, folder, "Nation Region", "IN_REGION").export_json()
    g = GraphEngine(spark)
    g.import_json(graph)
    return g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


def result_json(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "result")
    results.write_json(_engine(spark, folder, "Customer").cypher("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name"), path)
    return spark.read.json(path).select("k", "name")


def result_table(spark: SparkSession, folder: str) -> DataFrame:
    text = results.to_table(_engine(spark, folder, "Region").cypher("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name ORDER BY k"))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


def raw_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors kept beside the graph: many at once, one replaced, and the nearest ones."""
    g, vecs = GraphEngine(spark), graph_of(spark, folder).table("embeddings")
    g.insert_vectors(vecs.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit("{}").alias("metadata")))
    q = query_vector(spark, folder)
    g.insert_vector("0", [-x for x in q])
    return g.query_vectors(q, 10).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


# --------------------------------------------------------------------------- the vector store


def _items(spark: SparkSession, folder: str) -> DataFrame:
    vecs = graph_of(spark, folder).table("embeddings")
    return vecs.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))


def _written_store(spark: SparkSession, folder: str) -> VectorStore:
    store = VectorStore(spark, new_path(spark, "store"))
    store.create_index()
    store.insert_df(_items(spark, folder))
    return store


def _listed(store: VectorStore) -> DataFrame:
    """Every item: its id, version, first component and metadata field."""
    first = F.round(F.get("vector", F.lit(0)).cast("double"), 4)
    return store.list_items().select("id", F.col("version").cast("long").alias("version"), first.alias("x"), F.get_json_object("metadata", "$.label").alias("label"))


def _unit(spark: SparkSession, folder: str) -> list[float]:
    return [1.0] * len(query_vector(spark, folder))


def store_create(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index is there before and after it is created, and after it is deleted."""
    store = VectorStore(spark, new_path(spark, "store"))
    seen = [store.is_index_created()]
    store.create_index()
    seen.append(store.is_index_created())
    store.delete_index()
    return spark.createDataFrame(list(enumerate([*seen, store.is_index_created()])), "step long, there boolean")


def store_reopen(spark: SparkSession, folder: str) -> DataFrame:
    """All items of a store that another object has written."""
    return _listed(VectorStore(spark, _written_store(spark, folder).folder))


def store_one_file(spark: SparkSession, folder: str) -> DataFrame:
    """The one-file form, which holds small stores: an item for each region."""
    store = VectorStore(spark, new_path(spark, "store"))
    store.create_index(one_file=True)
    rows = graph_of(spark, folder).table("region").select("r_regionkey", "r_name").collect()
    store.insert_items([{"id": r[1], "vector": [float(r[0]), 1.0], "metadata": {"label": r[1]}} for r in rows])
    return _listed(VectorStore(spark, store.folder))


def store_insert(spark: SparkSession, folder: str) -> DataFrame:
    store = _written_store(spark, folder)
    store.insert_item(_unit(spark, folder), {"label": "new"}, "new")
    return _listed(store)


def store_insert_many(spark: SparkSession, folder: str) -> DataFrame:
    """Items that are new, that are there already, and two of one id in a batch: the last stays."""
    store, one = _written_store(spark, folder), _unit(spark, folder)
    store.insert_items([{"id": "a", "vector": one, "metadata": {"label": "first"}}, {"id": "0", "vector": one, "metadata": {"label": "zero"}}, {"id": "a", "vector": [3 * x for x in one], "metadata": {"label": "last"}}])
    return _listed(store)


def store_get(spark: SparkSession, folder: str) -> DataFrame:
    return _written_store(spark, folder).get_item("7").select("id", F.get_json_object("metadata", "$.label").alias("label"))


def store_update(spark: SparkSession, folder: str) -> DataFrame:
    store = _written_store(spark, folder)
    store.update_item("3", vector=_unit(spark, folder))
    store.update_item("4", metadata={"label": "changed"})
    return _listed(store)


def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    store, one = _written_store(spark, folder), _unit(spark, folder)
    store.upsert_item("5", one, {"label": "old"})
    store.upsert_item("new", one, {"label": "new"})
    return _listed(store)


def store_delete(spark: SparkSession, folder: str) -> DataFrame:
    store = _written_store(spark, folder)
    store.delete_item("6")
    store.delete_item("not there")
    return _listed(store)


def store_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that are ended stay, others are taken back."""
    store = _written_store(spark, folder)
    store.begin_update()
    store.delete_item("1")
    store.cancel_update()
    store.begin_update()
    store.delete_item("2")
    store.end_update()
    return _listed(VectorStore(spark, store.folder))


def store_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest items among those whose metadata has a value."""
    found = _written_store(spark, folder).query_items(query_vector(spark, folder), 10, filter={"label": 3})
    return found.select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


FUNCTIONS = (
    knn_batch, knn_index, knn_all, vec_normalize, vec_metric_scores, graph_stats, edge_type_counts, items_list_page, items_stats, items_query,
    seek_edge, index_seek, all_vectors, set_vector, catalog_names, derived_names, count_outside, neighbors_of,
    batch_create, batch_create_lists, create_with_vector, programmatic_changes, statement_batch, json_round_trip, json_export, json_objects, result_json, result_table, raw_vectors,
    store_create, store_reopen, store_one_file, store_insert, store_insert_many, store_get, store_update, store_upsert, store_delete, store_transactions, store_filter,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(Spec.__call__, spec) for name, spec in SPECS.items()} | {f.__name__: f for f in FUNCTIONS}

__all__ = ["ORACLE", "QUERIES", "SPECS"]
