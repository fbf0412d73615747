"""DuckDB statements that give the rows of the registered queries."""

#: The edges over the vectors: the i-th of 2N goes from i mod N to (7i + 3) mod N.
VECTOR_EDGES = """with recursive g as (
    select i % (select count(*) from embeddings) as src, (i * 7 + 3) % (select count(*) from embeddings) as dst,
           case i % 3 when 0 then 'CALLS' when 1 then 'IMPORTS' else 'REFERENCES' end as t
    from range(0, (select 2 * count(*) from embeddings)) r(i))"""

#: Items of a store that holds all vectors: what `_listed` shows of it.
LISTED = "select vec_id::varchar as id, 1::bigint as version, round(embedding[1]::double,4) as x, label::varchar as label from embeddings"

ORACLE = {
    "scan_label": 'select n_name as name from nation',
    "scan_all_count": 'select (select count(*) from region)+(select count(*) from nation) as c',
    "seek_param": 'select c_name as name from customer where c_custkey=42',
    "inline_props": "select c_custkey as k from customer where c_mktsegment='BUILDING'",
    "filter_compare": "select c_custkey as k,c_acctbal as bal from customer where c_acctbal>=9000 and c_mktsegment is distinct from 'BUILDING'",
    "filter_or_not": "select o_orderkey as k from orders where not(o_orderstatus='F' or o_totalprice<400000)",
    "filter_in": "select p_partkey as k,p_type as t from part where p_type in ('PROMO','SMALL')",
    "filter_contains": "select p_partkey as k from part where contains(p_name,'ring')",
    "filter_starts_ends": "select p_partkey as k from part where starts_with(p_name,'red') or ends_with(p_name,'widget')",
    "two_valued_null": "select c_custkey as k,o_totalprice as p from customer left join orders o on o_custkey=c_custkey and o_orderpriority='1-URGENT' and o_orderstatus='F' where not coalesce(o_totalprice>100000,false)",
    "arith_int": 'select p_partkey as k,(p_size//7)::bigint as d,(p_size%7)::bigint as m,(p_size*2-3)::bigint as x from part',
    "arith_div_zero": 'select p_partkey as k,case when p_size%5=0 then null else (100//(p_size%5))::bigint end as d from part',
    "concat_plus": "select n_name||'!' as s from nation",
    "case_searched": "select case when p_size<10 then 'low' when p_size<30 then 'mid' else 'high' end as tier,count(*) as c from part group by 1",
    "case_simple": "select o_orderkey as k,case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as s from orders",
    "with_chain": 'select p_type as t,max(p_retailprice) as m from part where p_retailprice>950 group by 1',
    "distinct_values": 'select distinct p_brand as b,p_type as t from part',
    "distinct_nodes": 'select distinct o_custkey as k from orders where o_totalprice>450000',
    "unwind_literal": 'select unnest([1,2,3])::bigint as x',
    "unwind_join": "select p_type as t,count(*) as c from part where p_type in ('PROMO','SMALL') group by 1",
    "expand_out": 'select c_name as name,o_orderkey as k from customer join orders on o_custkey=c_custkey where o_totalprice>450000',
    "expand_in": 'select o_orderkey as k,o_custkey as c from orders',
    "expand_both": 'select n_name as n,r_name as r from nation join region on n_regionkey=r_regionkey',
    "expand_both_homog": VECTOR_EDGES + " select src as a,dst as b from g where t='CALLS' union all select dst,src from g where t='CALLS'",
    "expand_into": 'select n_name as n,count(*) as c from orders join customer on c_custkey=o_custkey join lineitem l on l_orderkey=o_orderkey join (select distinct l_suppkey as sk,l_partkey as pk from lineitem) on pk=l_partkey join supplier on s_suppkey=sk and s_nationkey=c_nationkey join nation on n_nationkey=c_nationkey where o_totalprice>480000 group by 1',
    "expand_multi_type": VECTOR_EDGES + " select src as a,dst as b from g where t in ('CALLS','IMPORTS')",
    "expand_any_type": VECTOR_EDGES + ' select t,count(*) as c from g group by 1',
    "rel_property": 'select l_orderkey as o,l_partkey as p,l_quantity as q from lineitem where l_quantity>48',
    "multi_hop": 'select r_name as r,count(*) as c from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1',
    "four_hop_revenue": 'select r_name as r,sum(l_quantity) as q from region join nation on n_regionkey=r_regionkey join customer on c_nationkey=n_nationkey join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey group by 1',
    "varlen_1_3": VECTOR_EDGES + ", p(a,b,d,path) as (select src,dst,1,[src,dst] from g where t in ('CALLS') and src<>dst and true union all select p.a,g.dst,d+1,list_append(path,g.dst) from p join g on p.b=g.src and g.t in ('CALLS') where d<3 and not list_contains(path,g.dst)) select a,b from p where d>=1",
    "varlen_exact_2": VECTOR_EDGES + ", p(a,b,d,path) as (select src,dst,1,[src,dst] from g where t in ('CALLS') and src<>dst and true union all select p.a,g.dst,d+1,list_append(path,g.dst) from p join g on p.b=g.src and g.t in ('CALLS') where d<2 and not list_contains(path,g.dst)) select a,b from p where d>=2",
    "varlen_2_4": VECTOR_EDGES + ", p(a,b,d,path) as (select src,dst,1,[src,dst] from g where t in ('CALLS','REFERENCES') and src<>dst union all select p.a,g.dst,d+1,list_append(path,g.dst) from p join g on p.b=g.src and g.t in ('CALLS','REFERENCES') where d<4 and not list_contains(path,g.dst)) select a,count(*) as paths from p where d>=2 group by 1",
    "varlen_distinct": VECTOR_EDGES + ", p(a,b,d,path) as (select src,dst,1,[src,dst] from g where t in ('CALLS','IMPORTS') and src<>dst union all select p.a,g.dst,d+1,list_append(path,g.dst) from p join g on p.b=g.src and g.t in ('CALLS','IMPORTS') where d<4 and not list_contains(path,g.dst)) select distinct a,b from p where d>=1",
    "varlen_chain_default_cap": 'select a.conv_id as c,count(*) as n from conversations a join conversations b on a.conv_id=b.conv_id and b.turn>a.turn and b.turn-a.turn<=10 group by 1',
    "cartesian": 'select a.r_name as a,b.r_name as b from region a,region b where a.r_regionkey<b.r_regionkey',
    "comma_equi_join": 'select count(*) as n from customer join supplier on c_nationkey is not distinct from s_nationkey',
    "theta_join": 'select a.s_suppkey as a,b.s_suppkey as b from supplier a join supplier b on a.s_nationkey=b.s_nationkey and a.s_acctbal>b.s_acctbal',
    "correlated_match": 'select n_name as n,count(*) as pairs from nation join supplier on s_nationkey=n_nationkey join customer on c_nationkey=n_nationkey group by 1',
    "optional_match": "select c_custkey as k,count(o_orderkey) as n from customer left join orders on o_custkey=c_custkey and o_orderpriority='1-URGENT' and o_orderstatus='F' group by 1",
    "optional_anti": "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT' and o_orderstatus='F')",
    "count_variants": 'select count(*) as n,count(o_orderstatus) as s,count(distinct o_custkey) as d from orders',
    "sum_avg_min_max": 'select sum(p_size)::bigint as s,avg(p_size) as a,min(p_size)::bigint as lo,max(p_name) as hi from part',
    "sum_empty": 'select count(*) as c,coalesce(sum(p_size),0)::bigint as s,avg(p_size) as a from part where p_size>999',
    "group_by": 'select o_orderstatus as s,o_orderpriority as p,count(*) as c from orders group by 1,2',
    "collect_size_order": "select r_name as r,string_agg(n_name, ',' order by n_name) as names from nation join region on n_regionkey=r_regionkey group by 1",
    "having": 'select o_custkey as k,count(*) as n from orders group by 1 having count(*)>17',
    "two_level_agg": 'select n,count(*) as customers from (select o_custkey,count(*) as n from orders group by 1) group by 1',
    "agg_in_expr": 'select o_orderstatus as s,count(*)+1 as c from orders group by 1',
    "order_limit_skip": 'select o_orderkey as k,o_totalprice as p from orders order by p desc,k limit 10 offset 5',
    "limit_then_skip": 'select o_orderkey as k from orders order by k limit 5 offset 5',
    "order_nonprojected": 'select c_name as n from customer order by c_acctbal desc,c_name limit 7',
    "to_integer_string": 'select trunc(c_acctbal)::bigint as i,c_custkey::varchar as s from customer',
    "labels_fn": "select 'Nation' as l",
    "list_map_literals": "select r_regionkey::varchar||',7' as l, r_name as m from region",
    "vec_similarity": 'select vec_id as id,round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) as s from embeddings e,(select embedding from embeddings where vec_id=0) q',
    "vec_distance": 'select vec_id as id,round(list_distance(e.embedding::double[],q.embedding::double[]),6) as d from embeddings e,(select embedding from embeddings where vec_id=0) q',
    "vec_dot": 'select vec_id as id,round(list_inner_product(e.embedding::double[],q.embedding::double[]),6) as d from embeddings e,(select embedding from embeddings where vec_id=0) q',
    "vec_filter": 'select vec_id as id from embeddings e,(select embedding from embeddings where vec_id=0) q where list_cosine_similarity(e.embedding::double[],q.embedding::double[])>0.2',
    "knn_call": 'select vec_id as id,round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) as score from embeddings e,(select embedding from embeddings where vec_id=0) q order by score desc,id limit 10',
    "knn_traverse": VECTOR_EDGES + ", k as (select vec_id from embeddings e,(select embedding from embeddings where vec_id=0) q order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) desc,vec_id limit 10) select src as a,dst as n from g join k on dst=vec_id where t='CALLS'",
    "hybrid_rank": VECTOR_EDGES + " select b.vec_id as id,round(list_cosine_similarity(b.embedding::double[],q.embedding::double[]),6) as s from g join embeddings a on a.vec_id=src join embeddings b on b.vec_id=dst,(select embedding from embeddings where vec_id=0) q where t='REFERENCES' and a.label=3 order by s desc,id limit 5",
    "knn_batch": 'select q as q,id as id,rk as rk from (select q.vec_id as q,e.vec_id as id,row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[],q.embedding::double[]),6) desc,e.vec_id) as rk from embeddings e, embeddings q where q.vec_id%50=0 and e.vec_id<>q.vec_id) where rk<=3',
    "knn_all": 'select q as q,id as id,rk as rk from (select q.vec_id as q,e.vec_id as id,row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[],q.embedding::double[]),6) desc,e.vec_id) as rk from embeddings e, embeddings q where e.vec_id<>q.vec_id) where rk<=3',
    "vec_normalize": 'select vec_id as id,round(sqrt(list_inner_product(embedding::double[],embedding::double[])),6) as n,1.0::double as u from embeddings',
    "create_edges_query": 'select count(*) as c from region a,region b where a.r_regionkey<b.r_regionkey',
    "set_property": "select case when c_acctbal<0 then 'neg' end as f,count(*) as c from customer group by 1",
    "remove_property": 'select count(*) as c from nation where n_regionkey<>1',
    "detach_delete": "select count(*) as c from orders join customer on o_custkey=c_custkey where c_mktsegment<>'BUILDING'",
    "delete_edge": 'select count(*) as c from lineitem where l_quantity>=25',
    "merge_upsert": "select f,count(*) as c from (select case when n_name='NATION_1' then 0::bigint end as f from nation union all select 1::bigint) group by 1",
    "graph_stats": "select 'Customer' as l,count(*) as c from customer union all select 'Order',count(*) from orders union all select 'Part',count(*) from part union all select 'Supplier',count(*) from supplier union all select 'Nation',count(*) from nation union all select 'Region',count(*) from region",
    "items_list_page": 'select vec_id as id from embeddings order by vec_id limit 20 offset 40',
    "items_stats": 'select count(*) as items,max(len(embedding))::bigint as dimensions from embeddings',
    "vec_metric_scores": 'select vec_id as id,round(1/(1+list_distance(e.embedding::double[],q.embedding::double[])),6) as s from embeddings e,(select embedding from embeddings where vec_id=0) q',
    "seek_id": 'select c_name as name from customer where c_custkey=42',
    "null_tests": "select c_custkey as k,o_orderkey is null as missing,false as there from customer left join orders o on o_custkey=c_custkey and o_orderpriority='1-URGENT' and o_orderstatus='F'",
    "rel_inline_props": "select l_orderkey as o,l_partkey as p from lineitem join part on p_partkey=l_partkey where l_returnflag='R' and p_type='PROMO'",
    "neighbor_degrees": "select 'Order:'||l_orderkey as o,count(*) as n from lineitem group by l_orderkey having count(*)>=9",
    "create_nodes_query": 'select n_name as name,n_nationkey::bigint as key from nation where n_regionkey=2',
    "edge_type_counts": "select 'IN_REGION' as t,count(*) as c from nation union all select 'IN_NATION',(select count(*) from customer)+(select count(*) from supplier) union all select 'PLACED',count(*) from orders union all select 'CONTAINS',count(*) from lineitem",
    "items_query": 'select vec_id as id,round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) as score from embeddings e,(select embedding from embeddings where vec_id=0) q order by score desc,id limit 10',
    "varlen_edge_props": "select l_orderkey as o,count(*) as n from lineitem where l_returnflag='R' group by 1",
    "varlen_distinct_where": VECTOR_EDGES + ", p(a,b,d,path) as (select src,dst,1,[src,dst] from g join embeddings on vec_id=src and label=3 where t in ('CALLS','IMPORTS') and src<>dst union all select p.a,g.dst,d+1,list_append(path,g.dst) from p join g on p.b=g.src and g.t in ('CALLS','IMPORTS') where d<4 and not list_contains(path,g.dst)) select distinct a,b from p where d>=1",
    "unwind_scalar": 'select 5::bigint as x, true as y',
    "unwind_after_rows": 'select r_name as n, unnest([1,2])::bigint as x from region',
    "quoted_names": 'select r_name as "match" from region',
    "knn_approximate": 'select 0::bigint as id, 1.0::double as score',
    "multi_label_and": 'select n_name as name from nation where n_regionkey<=2',
    "delete_node": 'select n_name as name from nation where n_regionkey<>3',
    "knn_index": 'with n as (select count(*) as c from embeddings) select count(*) as queries, (count(*) * least(10, max(c) - 1))::bigint as asked, true as enough from embeddings, n where vec_id%50=0',
    "seek_edge": "select 'IN_REGION:Nation:5' as id,'Nation:5' as source,'Region:'||n_regionkey as target,'IN_REGION' as type from nation where n_nationkey=5",
    "index_seek": 'select o_orderkey as k,o_totalprice as p from orders where o_custkey=7',
    "all_vectors": "select 'Vec:'||vec_id as id,len(embedding)::bigint as n,round(embedding[1]::double,4) as x from embeddings",
    "set_vector": "select 'Vec:'||vec_id as id,case when vec_id=0 then 2.0 else round(embedding[1]::double,4) end as x,true as same from embeddings",
    "catalog_names": "select * from (values ('label','Customer'),('label','Nation'),('label','Region'),('type','IN_NATION'),('type','IN_REGION')) v(kind,name)",
    "derived_names": "select * from (values (0::bigint,'n.n_name'),(1::bigint,'id(..)'),(2::bigint,'expr'),(3::bigint,'r')) v(place,name)",
    "count_outside": 'select true as refused',
    "neighbors_of": "select 'Part:'||l_partkey as id from lineitem where l_orderkey=1",
    "batch_create": 'select c_name as name,count(*) as n,max(o_totalprice) as top from customer join orders on o_custkey=c_custkey group by c_custkey,c_name',
    "batch_create_lists": 'select i::bigint as a,i::bigint as w,(i+1)::bigint as b from range(0,4) r(i)',
    "create_with_vector": "select 'new' as name,1.0::double as score",
    "programmatic_changes": "select case when n_nationkey=1 then 'CHANGED' else n_name end as n,case when n_nationkey<>3 then r_name end as r from nation join region on n_regionkey=r_regionkey where n_nationkey<>2",
    "statement_batch": 'select n_name as name from nation where n_regionkey=2',
    "json_round_trip": 'select n_name as n,count(*) as c,sum(c_custkey)::bigint as s from customer join nation on c_nationkey=n_nationkey group by 1',
    "json_export": "select 'Customer:'||c_custkey as id,'Customer' as l,c_name as name,c_mktsegment as segment from customer",
    "json_objects": 'select n_name as n,r_name as r from nation join region on n_regionkey=r_regionkey',
    "result_json": 'select c_custkey::bigint as k,c_name as name from customer',
    "result_table": """select 'k | name' as line union all select '--------' union all select r_regionkey||' | "'||r_name||'"' from region""",
    "raw_vectors": 'select vec_id as id,round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) as score from embeddings e,(select embedding from embeddings where vec_id=0) q where vec_id<>0 order by score desc,id::varchar limit 10',
    "store_create": 'select * from (values (0::bigint,false),(1::bigint,true),(2::bigint,false)) v(step,there)',
    "store_reopen": LISTED,
    "store_one_file": 'select r_name as id,1::bigint as version,r_regionkey::double as x,r_name as label from region',
    "store_insert": LISTED + " union all select 'new',1::bigint,1.0,'new'",
    "store_insert_many": LISTED + " where vec_id<>0 union all select 'a',1::bigint,3.0,'last' union all select '0',1::bigint,1.0,'zero'",
    "store_get": "select vec_id::varchar as id,label::varchar as label from embeddings where vec_id=7",
    "store_update": "select vec_id::varchar as id,case when vec_id in (3,4) then 2 else 1 end::bigint as version,case when vec_id=3 then 1.0 else round(embedding[1]::double,4) end as x,case when vec_id=4 then 'changed' else label::varchar end as label from embeddings",
    "store_upsert": "select vec_id::varchar as id,case when vec_id=5 then 2 else 1 end::bigint as version,case when vec_id=5 then 1.0 else round(embedding[1]::double,4) end as x,case when vec_id=5 then 'old' else label::varchar end as label from embeddings union all select 'new',1::bigint,1.0,'new'",
    "store_delete": LISTED + " where vec_id<>6",
    "store_transactions": LISTED + " where vec_id<>2",
    "store_filter": 'select vec_id as id,round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]),6) as score from embeddings e,(select embedding from embeddings where vec_id=0) q where label=3 order by score desc,id::varchar limit 10',
}
