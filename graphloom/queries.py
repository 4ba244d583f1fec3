"""The queries of the graph operators and the SQL they are held against. Doubles are rounded, as sums depend on order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lineage import cut
from graphloom.operators import centrality, communities, components, embeddings, features, forecasting, modelling, motifs, multigraph, paths, sampling, similarity, temporal, triangles, walks
from graphloom.plans.match import match
from graphloom.plans.triples import TripleStore, var
from graphloom.streaming import changes, sketches, windows
from graphloom.streaming.updates import fold
from graphloom.views import VIEWS, cte, graph, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MICRO = 1_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def timed(df: DataFrame) -> DataFrame:
    """ts as epoch seconds."""
    return df.withColumn("timestamp", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / MICRO).cast("long"))


TIMED = "select source, target, cast(floor(epoch_us(ts)/1000000) as bigint) as timestamp from {v}"

# accessors and projections


@query("node_ids", cte("cust_supp") + " select source as id from cust_supp union select target from cust_supp")
def _(s, d):
    return graph(s, d, "cust_supp").node_ids()


@query("graph_density", cte("cust_supp") + ", n as (select count(*) c from (select source from cust_supp union select target from cust_supp)) select 'graph_density' as metric, round((select count(*) from cust_supp)/(c*(c-1.0)), 9) as value from n")
def _(s, d):
    return rounded(triangles.graph_density(graph(s, d, "cust_supp")), 9)


@query("adjacency", cte("part_copurchase") + " select source as id, array_to_string(list_sort(list(target)), ',') as neighbors from part_copurchase group by 1")
def _(s, d):
    return graph(s, d, "part_copurchase").adjacency().select("id", F.array_join(F.array_sort("neighbors"), ",").alias("neighbors"))


@query("degrees", cte("user_next") + ", e as (select source id, 0 i, 1 o from user_next union all select target, 1, 0 from user_next) select id as node_id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(*) as degree from e group by 1")
def _(s, d):
    return centrality.degrees(graph(s, d, "user_next"))


@query("degree_centrality", cte("user_next") + ", n as (select count(distinct id) c from (select source id from user_next union all select target from user_next)), i as (select source id from user_next union select target from user_next) select i.id as node_id, round(count(u.source)/(any_value(c)-1.0), 6) as degree_centrality from i cross join n left join user_next u on u.source=i.id group by 1")
def _(s, d):
    return rounded(centrality.degree_centrality(graph(s, d, "user_next")))


@query("filter_edges", cte("cust_supp") + " select source, target, weight from cust_supp where weight >= 2")
def _(s, d):
    return graph(s, d, "cust_supp").filter_edges("weight >= 2").edges.select("source", "target", "weight")


@query("remove_node", cte("part_copurchase") + ", m as (select min(source) x from part_copurchase) select source, target, weight from part_copurchase, m where source<>x and target<>x")
def _(s, d):
    g = graph(s, d, "part_copurchase")
    return g.remove_node(g.edges.agg(F.min("source")).first()[0]).edges.select("source", "target", "weight")


# centrality


def pagerank_sql(v: str, iterations: int, digits: int) -> str:
    text = cte(v) + f""", ids as (select source id from {v} union select target from {v}), n as (select count(*) c from ids),
    e as (select source, target, count(*) k from {v} group by 1,2), o as (select source, sum(k) k from e group by 1),
    r0 as (select id, 1.0::double/c s from ids, n)"""
    for i in range(iterations):
        text += f""", g{i} as (select target id, sum(r.s*e.k/o.k) x from r{i} r join e on e.source=r.id join o on o.source=e.source group by 1),
        d{i} as (select coalesce(sum(s),0) x from r{i} where id not in (select source from o)),
        r{i + 1} as (select ids.id, 0.15/c + 0.85*(coalesce(g{i}.x,0) + d{i}.x/c) s from ids cross join n cross join d{i} left join g{i} on g{i}.id=ids.id)"""
    return text + f" select id as node_id, round(s, {digits}) as pagerank_score from r{iterations}"


@query("pagerank", pagerank_sql("cust_supp", 10, 9))
def _(s, d):
    return rounded(centrality.pagerank(graph(s, d, "cust_supp"), max_iterations=10, tolerance=1e-15), 9)


@query("pagerank_users", pagerank_sql("user_next", 6, 8))
def _(s, d):
    return rounded(centrality.pagerank(graph(s, d, "user_next"), max_iterations=6, tolerance=1e-15), 8)


@query("pagerank_top_k", pagerank_sql("user_next", 6, 8) + " order by 2 desc, 1 limit 10")
def _(s, d):
    return rounded(centrality.pagerank(graph(s, d, "user_next"), max_iterations=6, tolerance=1e-15), 8).orderBy(F.desc("pagerank_score"), "node_id").limit(10)


def eigen_sql(v: str, iterations: int) -> str:
    text = cte(v) + f""", ids as (select source id from {v} union select target from {v}), e as (select source, target, count(*) k from {v} group by 1,2),
    r0 as (select id, 1/sqrt(count(*) over ()) s from ids)"""
    for i in range(iterations):
        text += f""", g{i} as (select ids.id, coalesce(sum(r.s*e.k),0) x from ids left join e on e.target=ids.id left join r{i} r on r.id=e.source group by 1),
        r{i + 1} as (select id, x/sqrt(sum(x*x) over ()) s from g{i})"""
    return text + f" select id as node_id, round(s, 6) as eigenvector_centrality from r{iterations}"


@query("eigenvector_centrality", eigen_sql("user_next", 8))
def _(s, d):
    return rounded(centrality.eigenvector_centrality(graph(s, d, "user_next"), 8, 1e-15))


def layers_sql(v: str, depth: int) -> str:
    """d(s, t, depth, sigma): breadth-first layers with path counts, from every vertex."""
    text = cte(v) + f", ids as (select source id from {v} union select target from {v}), e as (select distinct source, target from {v} where source<>target), l0 as (select id s, id t, 0 depth, 1.0::double sigma from ids)"
    for i in range(1, depth + 1):
        text += f", l{i} as (select * from l{i - 1} union all select x.s, e.target, {i}, sum(x.sigma) from l{i - 1} x join e on e.source=x.t where x.depth={i - 1} and not exists (select 1 from l{i - 1} y where y.s=x.s and y.t=e.target) group by 1,2)"
    return text + f", d as materialized (select * from l{depth})"


@query("closeness_centrality", layers_sql("user_next", 5) + ", n as (select count(*) c from ids) select ids.id as node_id, round(coalesce((count(t) filter (depth>0))/(any_value(c)-1.0)/(sum(depth)/nullif(count(t) filter (depth>0),0)::double),0),6) as closeness_centrality from ids cross join n left join d on d.s=ids.id group by 1")
def _(s, d):
    return rounded(centrality.closeness_centrality(graph(s, d, "user_next")))


@query("betweenness_centrality", layers_sql("user_next", 5) + """, n as (select count(*) c from ids),
  b as (select a.t v, sum(a.sigma*z.sigma/w.sigma) x from d a join d z on z.s=a.t join d w on w.s=a.s and w.t=z.t and w.depth=a.depth+z.depth where a.depth>0 and z.depth>0 and a.s<>z.t group by 1)
  select ids.id as node_id, round(coalesce(x,0)*2/((c-1.0)*(c-2.0)),6) as betweenness_centrality from ids cross join n left join b on b.v=ids.id""")
def _(s, d):
    return rounded(centrality.betweenness_centrality(graph(s, d, "user_next")))


@query("multi_bfs", layers_sql("event_flow", 4) + " select s as source, t as id, depth from d")
def _(s, d):
    g = graph(s, d, "event_flow")
    return paths.multi_bfs(g, g.node_ids())


# paths


def all_pairs_sql(v: str, doublings: int) -> str:
    text = cte(v) + f", ids as (select source id from {v} union select target from {v}), w0 as (select s, t, min(w) w from (select source s, target t, weight w from {v} union all select id, id, 0.0 from ids) group by 1,2)"
    for i in range(doublings):
        text += f", w{i + 1} as materialized (select a.s, b.t, min(a.w+b.w) w from w{i} a join w{i} b on a.t=b.s group by 1,2)"
    return text + f", w as (select * from w{doublings})"


@query("all_pairs", all_pairs_sql("nation_trade", 5) + " select s as source, t as target, round(w, 6) as distance from w")
def _(s, d):
    return rounded(paths.all_pairs(graph(s, d, "nation_trade")), 6)


@query("shortest_path_from", all_pairs_sql("nation_trade", 5) + " select s as source, t as target, round(w, 6) as distance from w where s='N3' and t<>'N3'")
def _(s, d):
    return rounded(paths.shortest_path(graph(s, d, "nation_trade"), "N3"), 6)


@query("shortest_path_to", all_pairs_sql("nation_trade", 5) + " select s as source, t as target, round(w, 6) as distance from w where s='N3' and t='N7'")
def _(s, d):
    return rounded(paths.shortest_path(graph(s, d, "nation_trade"), "N3", "N7").drop("path"), 6)


@query("shortest_path_batch", all_pairs_sql("nation_trade", 5) + " select i as source, j as target, round(w, 6) as distance from (select x.id i, y.id j from ids x join ids y on x.id<y.id) p left join w on w.s=p.i and w.t=p.j")
def _(s, d):
    g = graph(s, d, "nation_trade")
    ids = g.node_ids()
    pairs = ids.select(F.col("id").alias("source")).join(ids.select(F.col("id").alias("target")), F.col("source") < F.col("target"))
    return rounded(paths.shortest_path_batch(g, pairs), 6)


PATHS_SQL = cte("event_flow") + """, p as (select source s, [source] nodes, 0.0::double w, 0 depth from (select distinct source from event_flow)
  union all select p.s, list_append(p.nodes, e.target), p.w+e.weight, p.depth+1 from p join event_flow e on e.source=p.nodes[len(p.nodes)] where not list_contains(p.nodes, e.target) and p.depth<{0} {1})"""


@query("all_paths", PATHS_SQL.format(4, "and p.nodes[len(p.nodes)]<>'purchase'") + " select s as source, 'purchase' as target, depth::bigint as path_length, array_to_string(nodes, '>') as path from p where s='view' and nodes[len(nodes)]='purchase'")
def _(s, d):
    return paths.all_paths(graph(s, d, "event_flow"), "view", "purchase", 4).withColumns({"path_length": F.col("path_length").cast("long"), "path": F.array_join("path", ">")})


@query("recursive_paths", PATHS_SQL.format(3, "") + " select array_to_string(nodes, '>') as nodes, w as total_weight, depth::bigint as depth from p where s='view'")
def _(s, d):
    return paths.recursive_paths(graph(s, d, "event_flow"), "view", max_depth=3, max_paths=None).withColumns({"nodes": F.array_join("nodes", ">"), "depth": F.col("depth").cast("long")})


@query("reachable", cte("order_chain") + ", r as (select 'O1' id union select target from r join order_chain on source=r.id) select id from r where id<>'O1'")
def _(s, d):
    return paths.reachable(graph(s, d, "order_chain"), "O1")


# components and communities


@query("weakly_connected_components", cte("order_chain") + """, e as (select source a, target b from order_chain union select target, source from order_chain),
  r as (select a, a b from e union select r.a, e.b from r join e on e.a=r.b), m as (select a, min(b) c from r group by 1)
  select a as node_id, c as component, dense_rank() over (order by c)-1 as component_id from m""")
def _(s, d):
    return components.weakly_connected_components(graph(s, d, "order_chain"))


@query("component_sizes", cte("part_copurchase") + """, e as (select source a, target b from part_copurchase union select target, source from part_copurchase),
  ids as (select a id from e), l0 as (select distinct id, id c from ids)""" + "".join(f", l{i + 1} as materialized (select l.id, least(any_value(l.c), min(m.c)) c from l{i} l join e on e.a=l.id join l{i} m on m.id=e.b group by 1)" for i in range(24)) + " select c as component, count(*) as size from l24 group by 1")
def _(s, d):
    return components.component_sizes(components.weakly_connected_components(graph(s, d, "part_copurchase")))


@query("strongly_connected_components", cte("user_next") + """, e as (select distinct source a, target b from user_next), r as (select a, a b from e union select b, b from e union select r.a, e.b from r join e on e.a=r.b),
  m as (select x.a, min(x.b) c from r x join r y on x.a=y.b and x.b=y.a group by 1) select a as node_id, c as component, dense_rank() over (order by c)-1 as component_id from m""")
def _(s, d):
    return components.strongly_connected_components(graph(s, d, "user_next"))


@query("louvain")
def _(s, d):
    return communities.louvain(graph(s, d, "part_copurchase"))


@query("leiden")
def _(s, d):
    return communities.leiden(graph(s, d, "part_copurchase"))


# triangles and motifs

TRIANGLES = ", p as (select distinct least(source,target) a, greatest(source,target) b from {v} where source<>target), t as materialized (select x.a x, x.b y, y.b z from p x join p y on x.b=y.a join p z on z.a=x.a and z.b=y.b), k as (select id, count(*) n from (select x id from t union all select y from t union all select z from t) group by 1), g as (select id, count(*) n from (select a id from p union all select b from p) group by 1)"


@query("triangle_count", cte("user_next") + TRIANGLES.format(v="user_next") + " select 'triangle_count' as metric, count(*) as value from t")
def _(s, d):
    return triangles.triangle_count(graph(s, d, "user_next"))


@query("triangles_per_node", cte("user_next") + TRIANGLES.format(v="user_next") + " select g.id as node_id, coalesce(k.n,0) as triangles from g left join k on k.id=g.id")
def _(s, d):
    return triangles.triangles_per_node(graph(s, d, "user_next"))


@query("clustering_local", cte("part_copurchase") + TRIANGLES.format(v="part_copurchase") + " select g.id as node_id, round(case when g.n<2 then 0 else coalesce(k.n,0)/(g.n*(g.n-1)/2.0) end, 6) as clustering_coefficient from g left join k on k.id=g.id")
def _(s, d):
    return rounded(triangles.clustering_coefficient(graph(s, d, "part_copurchase")))


@query("clustering_global", cte("user_next") + TRIANGLES.format(v="user_next") + " select 'global_clustering_coefficient' as metric, round(least(1.0, sum(coalesce(k.n,0))/sum(g.n*(g.n-1)/2.0)), 6) as value from g left join k on k.id=g.id")
def _(s, d):
    return rounded(triangles.clustering_coefficient(graph(s, d, "user_next"), "global"))


@query("motif_counts", cte("part_copurchase") + """, p as (select distinct least(source,target) a, greatest(source,target) b from part_copurchase where source<>target), s as (select a, b from p union all select b, a from p),
  w as (select distinct list_sort([x.a, x.b, y.b]) n from s x join s y on x.b=y.a and x.a<>y.b), c as (select n, (select count(*) from p where list_contains(n, a) and list_contains(n, b)) ne from w)
  select 2 as nv, 1 as ne, '1,1' as degrees, count(*) as occurrences from p union all select 3, ne::int, case when ne=3 then '2,2,2' else '1,1,2' end, count(*) from c group by 2, 3""")
def _(s, d):
    return motifs.motif_counts(graph(s, d, "part_copurchase"), 3).select("nv", "ne", F.array_join(F.transform("degrees", lambda x: x.cast("string")), ",").alias("degrees"), "occurrences")


@query("subgraph_match", cte("part_copurchase") + """, s as (select source a, target b from part_copurchase where source<>target union select target, source from part_copurchase where source<>target)
  select x.a as a, x.b as b, y.b as c from s x join s y on x.b=y.a join s z on z.a=y.b and z.b=x.a where x.a<>y.b""")
def _(s, d):
    return motifs.subgraph_match(graph(s, d, "part_copurchase"), [("a", "b"), ("b", "c"), ("c", "a")])


# walks and samples


@query("random_walk")
def _(s, d):
    return walks.random_walk(graph(s, d, "user_next"), 6, 2, seed=1)


@query("node2vec_walks")
def _(s, d):
    return walks.node2vec_walks(graph(s, d, "part_copurchase"), 5, 1, p=0.5, q=2.0, seed=1)


@query("transition_probabilities", cte("event_flow") + """, s as (select distinct source a, target b from event_flow where source<>target union select target, source from event_flow where source<>target),
  t as (select x.a prev, x.b source, y.b nxt, case when y.b=x.a then 2.0 when exists (select 1 from s z where z.a=x.a and z.b=y.b) then 1.0 else 0.5 end w from s x join s y on y.a=x.b)
  select prev, source, nxt as next, round(w/sum(w) over (partition by prev, source), 6) as probability from t""")
def _(s, d):
    return rounded(walks.transition_probabilities(graph(s, d, "event_flow"), 0.5, 2.0))


@query("sample_nodes")
def _(s, d):
    return sampling.sample_nodes(graph(s, d, "cust_supp"), seed=2)


@query("sample_edges")
def _(s, d):
    return sampling.sample_edges(graph(s, d, "cust_supp"), 0.3, seed=2)


@query("snowball", cte("order_chain") + ", r as (select 'O1' id, 0 depth union select target, depth+1 from r join order_chain on source=r.id where depth<2) select id as node_id, min(depth) as depth from r group by 1")
def _(s, d):
    return sampling.snowball(graph(s, d, "order_chain"), ["O1"], 2)


@query("forest_fire")
def _(s, d):
    return sampling.forest_fire(graph(s, d, "user_next"), ["U1"], 0.4, seed=3)


# several graphs


@query("multigraph_statistics", cte("priority_graphs") + """, n as (select graph_name, count(distinct id) nodes from (select graph_name, source id from priority_graphs union all select graph_name, target from priority_graphs) group by 1)
  select g.graph_name, any_value(nodes) as nodes, count(*) as edges, round(avg(weight),6) as avg_weight, round(sum(weight),6) as total_weight, round(count(*)/(any_value(nodes)*(any_value(nodes)-1.0)),6) as density from priority_graphs g join n on n.graph_name=g.graph_name group by 1""")
def _(s, d):
    return rounded(multigraph.MultiGraph(view(s, d, "priority_graphs")).statistics())


@query("multigraph_merge", cte("priority_graphs") + " select source, target, round(avg(weight),6) as weight, array_to_string(list_sort(list(distinct graph_name)), ',') as graph_name from priority_graphs group by 1,2")
def _(s, d):
    return rounded(multigraph.MultiGraph(view(s, d, "priority_graphs")).merge(combine="average"))


@query("multigraph_keep_last", cte("priority_graphs") + " select source, target, arg_max(weight, row(seq, graph_name, weight)) as weight, array_to_string(list_sort(list(distinct graph_name)), ',') as graph_name from priority_graphs group by 1,2")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).merge(combine="keep_last")


@query("cross_graph_nodes", cte("priority_graphs") + ", n as (select distinct graph_name g, source id from priority_graphs union select graph_name, target from priority_graphs) select id as node_id, array_to_string(list_sort(list(g)), ',') as graphs from n group by 1 having count(*)>=2")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).cross_graph_nodes().withColumn("graphs", F.array_join("graphs", ","))


@query("graph_similarity", cte("priority_graphs") + """, e as (select distinct graph_name g, source, target from priority_graphs), n as (select g, count(*) c from e group by 1),
  b as (select x.g a, y.g b, count(*) k from e x join e y on x.source=y.source and x.target=y.target and x.g<y.g group by 1,2)
  select x.g as a, y.g as b, round(coalesce(k,0)/(x.c+y.c-coalesce(k,0)),6) as similarity from n x join n y on x.g<y.g left join b on b.a=x.g and b.b=y.g""")
def _(s, d):
    return rounded(multigraph.MultiGraph(view(s, d, "priority_graphs")).similarity())


@query("edit_distance", cte("priority_graphs") + """, a as (select distinct source, target from priority_graphs where graph_name like '1%'), b as (select distinct source, target from priority_graphs where graph_name like '2%'),
  va as (select source id from a union select target from a), vb as (select source id from b union select target from b),
  c as (select (select count(*) from (select * from vb except select * from va)) ni, (select count(*) from (select * from va except select * from vb)) nd, (select count(*) from (select * from b except select * from a)) ei, (select count(*) from (select * from a except select * from b)) ed,
    (select count(*) from va)+(select count(*) from vb)+(select count(*) from a)+(select count(*) from b) z)
  select ni as node_inserts, nd as node_deletes, ei as edge_inserts, ed as edge_deletes, (ni+nd+ei+ed)::double as distance, round(case when z=0 then 0 else (ni+nd+ei+ed)/z::double end,6) as normalised from c""")
def _(s, d):
    e = view(s, d, "priority_graphs")
    of = lambda k: Graph.from_edges(e.where(F.col("graph_name").startswith(k)).select("source", "target").distinct())
    return rounded(multigraph.edit_distance(of("1"), of("2")))


# query languages


@query("match_two_hops", cte("cust_supp", "trade_vertices") + """ select c.source as a, c.target as b, x.source as c from cust_supp c join cust_supp x on x.target=c.target
  join trade_vertices va on va.id=c.source and va.segment='BUILDING' join trade_vertices vb on vb.id=c.target and vb.label='Supplier' and vb.balance>9000 join trade_vertices vc on vc.id=x.source and vc.balance<0""")
def _(s, d):
    g = Graph(view(s, d, "trade_vertices"), view(s, d, "cust_supp"))
    return match(g, "MATCH (a:Customer {segment: 'BUILDING'})-[]->(b:Supplier)<-[]-(c) WHERE b.balance > 9000 AND c.balance < 0")


@query("match_return", cte("cust_supp", "trade_vertices") + " select e.source as a, va.balance as \"a.balance\", e.weight as \"r.weight\" from cust_supp e join trade_vertices va on va.id=e.source join trade_vertices vb on vb.id=e.target where e.weight>=2 and (va.segment='MACHINERY' or not vb.balance>=0)")
def _(s, d):
    g = Graph(view(s, d, "trade_vertices"), view(s, d, "cust_supp"))
    return match(g, "MATCH (a)-[r]->(b) WHERE r.weight >= 2 AND (a.segment = 'MACHINERY' OR NOT b.balance >= 0) RETURN a, a.balance, r.weight")


@query("triples_select", cte("place_triples") + """ select a.subject as s, b.object as n from place_triples a join place_triples b on a.subject=b.subject and b.predicate='inNation'
  join place_triples c on c.subject=b.object and c.predicate='inRegion' and c.object='region:ASIA' join place_triples v on v.subject=a.subject and v.predicate='balance'
  where a.predicate='rdf:type' and a.object='Supplier' and try_cast(v.object as double)>5000""")
def _(s, d):
    st = TripleStore(view(s, d, "place_triples"))
    return st.select("s", "n").where(var("s"), "rdf:type", "Supplier").where(var("s"), "inNation", var("n")).where(var("n"), "inRegion", "region:ASIA").where(var("s"), "balance", var("b")).filter("b", ">", 5000).run()


@query("triples_ordered", cte("place_triples") + " select subject as s, object as b from place_triples where predicate='balance' order by try_cast(object as double) desc nulls last, object desc, subject limit 5 offset 2")
def _(s, d):
    return TripleStore(view(s, d, "place_triples")).select("s", "b").where(var("s"), "balance", var("b")).order_by("b", True).order_by("s").offset(2).limit(5).run()


@query("triples_statistics", cte("place_triples") + " select count(*) as triples, count(distinct subject) as subjects, count(distinct predicate) as predicates, count(distinct object) as objects from place_triples")
def _(s, d):
    return TripleStore(view(s, d, "place_triples")).statistics()


@query("graph_to_triples", cte("part_copurchase") + """ select 'node:'||id as subject, 'rdf:type' as predicate, 'graph:Node' as object, 'uri' as object_type from (select source id from part_copurchase union select target from part_copurchase)
  union all select 'node:'||source, 'graph:connectedTo', 'node:'||target, 'uri' from part_copurchase union all select 'edge:'||source||'_'||target, 'graph:weight', cast(weight as varchar), 'literal' from part_copurchase""")
def _(s, d):
    return TripleStore.from_graph(graph(s, d, "part_copurchase")).export()


# time

E = ", e as (" + TIMED + ")"


@query("edges_in_window", cte("user_next") + E.format(v="user_next") + ", m as (select min(timestamp) lo, max(timestamp) hi from e) select source, target, timestamp from e, m where timestamp between lo+(hi-lo)//4 and lo+(hi-lo)//2")
def _(s, d):
    e = timed(view(s, d, "user_next")).select("source", "target", "timestamp")
    lo, hi = e.agg(F.min("timestamp"), F.max("timestamp")).first()
    return temporal.in_window(e, lo + (hi - lo) // 4, lo + (hi - lo) // 2)


@query("edges_per_bucket", cte("user_next") + E.format(v="user_next") + " select cast(floor(timestamp/3600.0)*3600 as bigint) as bucket, count(*) as edges from e group by 1")
def _(s, d):
    return temporal.edges_per_bucket(timed(view(s, d, "user_next")), 3600)


@query("most_active", cte("user_next") + " select id as node_id, count(*) as activity from (select source id from user_next union all select target from user_next) group by 1 order by 2 desc, 1 limit 10")
def _(s, d):
    return temporal.most_active(timed(view(s, d, "user_next")), 10)


@query("active_nodes", cte("user_next") + E.format(v="user_next") + ", m as (select max(timestamp) hi from e), w as (select source, target from e, m where timestamp between hi-86400*3 and hi) select source as node_id from w union select target from w")
def _(s, d):
    e = timed(view(s, d, "user_next"))
    return temporal.active_nodes(e, e.agg(F.max("timestamp")).first()[0], 3 * temporal.DAY)


@query("temporal_centrality", cte("user_next") + E.format(v="user_next") + ", m as (select min(timestamp) lo, max(timestamp) hi from e), w as (select source, target from e, m where timestamp between lo and lo+(hi-lo)//2), n as (select count(*) c from w) select id as node_id, round(count(*)/any_value(c)::double,6) as centrality from (select source id from w union all select target from w) cross join n group by 1")
def _(s, d):
    e = timed(view(s, d, "user_next"))
    lo, hi = e.agg(F.min("timestamp"), F.max("timestamp")).first()
    return rounded(temporal.temporal_centrality(e, lo, lo + (hi - lo) // 2))


@query("temporal_paths", cte("order_chain") + E.format(v="order_chain") + """, p as (select 'O1'::varchar s, target t, timestamp ts, 1 hops from e where source='O1' union all select p.s, e.target, e.timestamp, hops+1 from p join e on e.source=p.t and e.timestamp>=p.ts where hops<3)
  select array_to_string([s, t], '>') as ends, hops::bigint as hops from p where t=(select target from e where source=(select target from e where source='O1'))""")
def _(s, d):
    e = timed(view(s, d, "order_chain"))
    second = e.where("source = 'O1'").select(F.col("target").alias("source")).join(e, "source").select("target").first()
    got = temporal.temporal_paths(e, "O1", second[0] if second else "O1", max_hops=3)
    return got.select(F.concat_ws(">", F.element_at("nodes", 1), F.element_at("nodes", -1)).alias("ends"), F.col("hops").cast("long").alias("hops"))


@query("evolution", cte("user_next") + E.format(v="user_next") + """, m as (select min(timestamp) lo, max(timestamp) hi from e), s as (select unnest(generate_series(lo, hi, 86400*7)) a from m), f as (select id, min(timestamp) t from (select source id, timestamp from e union all select target, timestamp from e) group by 1)
  select a as at, (select count(*) from f where t<=a) as nodes, (select count(*) from e where timestamp<=a) as edges from s""")
def _(s, d):
    e = timed(view(s, d, "user_next"))
    lo, hi = e.agg(F.min("timestamp"), F.max("timestamp")).first()
    return temporal.evolution(e, lo, hi, 7 * temporal.DAY).select("at", "nodes", "edges")


# series

SERIES = ", s as (select metric, ts, value, row_number() over (partition by metric order by ts)-1 i from daily_series)"


@query("trends", cte("daily_series") + SERIES + " select metric, count(*) as n, round(coalesce(regr_slope(value,i),0),6) as slope, round(coalesce(corr(value,i),0),6) as correlation, round(stddev_pop(value),6) as volatility, round(avg(value),6) as mean from s group by 1")
def _(s, d):
    return rounded(forecasting.trends(view(s, d, "daily_series")).select("metric", "n", "slope", "correlation", "volatility", "mean"))


@query("autocorrelation", cte("daily_series") + SERIES + ", m as (select metric, avg(value) a, count(*) n from s group by 1), l as (select s.metric, value-a x, lag(value,12) over (partition by s.metric order by ts)-a y, n from s join m on m.metric=s.metric) select metric, any_value(n) as n, round(coalesce(sum(x*y)/sum(x*x),0),6) as autocorrelation from l group by 1")
def _(s, d):
    return rounded(forecasting.autocorrelation(view(s, d, "daily_series"), 12))


@query("linear_forecast", cte("daily_series") + SERIES + ", m as (select metric, arg_max(value, ts) l, coalesce(regr_slope(value,i),0) b from s group by 1) select metric, k::int as step, round(greatest(0, l+b*k),6) as value from m, range(1,8) r(k)")
def _(s, d):
    return rounded(forecasting.linear_forecast(view(s, d, "daily_series"), 7).select("metric", "step", "value"))


@query("consistency", cte("daily_series") + ", d as (select metric, ts, sign(value-lag(value) over (partition by metric order by ts)) x from daily_series), l as (select metric, x, lag(x) over (partition by metric order by ts) y from d) select metric, round(coalesce(avg(case when y is not null then (x*y>0)::int end),0.5),6) as consistency from l group by 1")
def _(s, d):
    return rounded(forecasting.consistency(view(s, d, "daily_series")))


@query("change_points", cte("daily_series") + SERIES + """, n as (select metric, count(*) n, greatest(2, count(*)//4) h from s group by 1 having count(*)>=10),
  x as (select s.metric, s.ts, i, n, h, (select avg(value) from s b where b.metric=s.metric and b.i>=s.i-h and b.i<s.i) m0, (select avg(value) from s b where b.metric=s.metric and b.i>=s.i and b.i<s.i+h) m1 from s join n on n.metric=s.metric where i>=h and i+h<=n)
  select metric, ts, round(abs(m1-m0)/abs(m0),6) as change from x where abs(m1-m0)/abs(m0)>0.2""")
def _(s, d):
    return rounded(forecasting.change_points(view(s, d, "daily_series")).select("metric", "ts", "change"))


@query("lagged_correlation", cte("daily_series") + SERIES + """, c as (select a.metric cause, b.metric effect, k lag, abs(corr(a.value,b.value)) r, count(*) n from s a cross join range(1,4) z(k) join s b on b.i=a.i+k and a.metric<>b.metric group by 1,2,3)
  select cause, effect, round(max(r),6) as strength from c where n>=3 and r>0.05 group by 1,2""")
def _(s, d):
    return rounded(forecasting.lagged_correlation(view(s, d, "daily_series"), 3, 0.05).select("cause", "effect", "strength"))


# streams, over tables as batches


@query("windowed_counts", "select cast(time_bucket(interval '1 hour', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value),4) as total from events group by 1,2")
def _(s, d):
    return rounded(windows.windowed_counts(table(s, d, "events"), "1 hour", keys=("event_type",), value="value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), 4)


@query("sliding_counts", "with h as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval '1 hour']) as s from events) select cast(s as timestamp) as start, count(*) as n from h group by 1")
def _(s, d):
    return windows.windowed_counts(table(s, d, "events"), "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval '2 hours' then 0 else 1 end b from events window w as (partition by user_id order by ts, event_id)), k as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, cast(min(ts) as timestamp) as start, count(*) as n from k group by user_id, k")
def _(s, d):
    return windows.sessions(table(s, d, "events"), "user_id", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")



@query("change_log_fold", """with e as (select 'U'||cast(user_id as varchar(20)) source, case when event_id%3=0 then 'Tx' else 'T'||event_type end target, value weight, event_id seq, event_type='error' rm from events),
  l as (select source, target, max(seq) filter (rm) r, max(seq) filter (not rm) a, arg_max(weight, seq) filter (not rm) weight from e group by 1,2)
  select source, target, weight from l where a is not null and (r is null or a>r)""")
def _(s, d):
    e = table(s, d, "events")
    source, target = F.concat(F.lit("U"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 3 == 0, "Tx").otherwise(F.concat(F.lit("T"), "event_type"))
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove_edge").otherwise("add_edge").alias("op"), F.lit(None).cast("string").alias("node_id"), source.alias("source"), target.alias("target"), F.col("value").alias("weight"))
    return fold(Graph.empty(s), log)[1]


@query("count_min")
def _(s, d):
    e = table(s, d, "events")
    return sketches.CountMin.of(e, "user_id", width=2000).estimate(e, "user_id")


@query("bloom", "select distinct user_id, true as maybe from events")
def _(s, d):
    e = table(s, d, "events")
    return sketches.Bloom.of(e, "user_id").contains(e, "user_id")


@query("distinct_sketch")
def _(s, d):
    return sketches.estimate_distinct(sketches.distinct_sketch(table(s, d, "events"), "user_id"))


@query("metric_anomalies")
def _(s, d):
    return changes.metric_anomalies(changes.graph_metrics(graph(s, d, "part_copurchase"), 0).unionByName(changes.graph_metrics(graph(s, d, "user_next"), 1)))


# features and models


@query("pair_features", cte("part_copurchase") + """, s as (select distinct source a, target b from part_copurchase union select target, source from part_copurchase), g as (select a id, count(*) n from s group by 1), m as (select id, count(*) n from (select source id from part_copurchase union all select target from part_copurchase) group by 1),
  p as (select distinct least(source,target) a, greatest(source,target) b from part_copurchase where source<>target), c as (select p.a, p.b, count(*) k, sum(case when m.n>1 then 1/ln(m.n) else 0 end) aa from p join s x on x.a=p.a join s y on y.a=p.b and y.b=x.b join m on m.id=x.b group by 1,2)
  select p.a as source, p.b as target, coalesce(k,0) as common_neighbors, round(coalesce(k,0)/(ga.n+gb.n-coalesce(k,0))::double,6) as jaccard, round(coalesce(aa,0),6) as adamic_adar, ma.n*mb.n as preferential_attachment
  from p join g ga on ga.id=p.a join g gb on gb.id=p.b join m ma on ma.id=p.a join m mb on mb.id=p.b left join c on c.a=p.a and c.b=p.b""")
def _(s, d):
    return rounded(features.pair_features(graph(s, d, "part_copurchase")))


@query("node_features")
def _(s, d):
    return features.node_features(graph(s, d, "part_copurchase"), exact=False)


@query("core_numbers")
def _(s, d):
    return features.core_numbers(graph(s, d, "part_copurchase"))


@query("normalised_adjacency", cte("part_copurchase") + ", s as (select source a, target b from part_copurchase where source<>target union select target, source from part_copurchase where source<>target), g as (select a id, count(*) n from s group by 1) select a as source, b as target, round(1/sqrt(x.n*y.n),6) as weight from s join g x on x.id=a join g y on y.id=b")
def _(s, d):
    return rounded(embeddings.normalised_adjacency(graph(s, d, "part_copurchase")))


@query("gcn_forward")
def _(s, d):
    g = graph(s, d, "part_copurchase")
    return rounded(embeddings.gcn_forward(g, embeddings.random_features(g, 4), np.arange(8).reshape(4, 2) / 10 - 0.3).select("id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1")))


@query("nearest_neighbours", "with e as (select vec_id, embedding::double[] v from embeddings), p as (select a.vec_id id, b.vec_id neighbour, list_cosine_similarity(a.v, b.v) s from e a join e b on a.vec_id<>b.vec_id), r as (select *, row_number() over (partition by id order by s desc, neighbour) k from p) select id, neighbour, round(s,6) as similarity, k::int as rank from r where k<=5")
def _(s, d):
    return rounded(similarity.nearest_neighbours(table(s, d, "embeddings"), 5, "vec_id"))


@query("weisfeiler_lehman")
def _(s, d):
    return similarity.weisfeiler_lehman(graph(s, d, "part_copurchase"), 2)


@query("path_length_histogram", "with o as (select count(*) c from orders group by o_custkey) select k::int as length, 2*sum(c-k)::bigint as n from o, range(1,11) r(k) where c>k group by 1")
def _(s, d):
    return similarity.path_length_histogram(graph(s, d, "order_chain"))


@query("matrix_multiply", cte("event_flow") + " select a.source as i, b.target as j, sum(a.weight*b.weight) as value from event_flow a join event_flow b on a.target=b.source group by 1,2")
def _(s, d):
    m = view(s, d, "event_flow").select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("weight").alias("value"))
    return embeddings.matrix_multiply(m, m)


# accessors and changes of a graph


@query("neighbors", cte("user_next") + " select target as id from user_next where source='U1'")
def _(s, d):
    return graph(s, d, "user_next").neighbors("U1")


@query("predecessors", cte("user_next") + " select source as id from user_next where target='U1'")
def _(s, d):
    return graph(s, d, "user_next").predecessors("U1")


@query("edge_lookup", cte("event_flow") + " select exists(select 1 from event_flow where 'view' in (source, target)) as has_node, exists(select 1 from event_flow where source='view' and target='purchase') as has_edge, exists(select 1 from event_flow where source='view' and target='nowhere') as has_other, (select min(weight) from event_flow where source='view' and target='purchase') as weight")
def _(s, d):
    g = graph(s, d, "event_flow")
    row = (g.has_node("view"), g.has_edge("view", "purchase"), g.has_edge("view", "nowhere"), g.edge_weight("view", "purchase"))
    return s.createDataFrame([row], "has_node boolean, has_edge boolean, has_other boolean, weight double")


@query("add_edge", cte("event_flow") + " select source, target, weight from event_flow union all select 'view', 'archive', 2.5")
def _(s, d):
    return graph(s, d, "event_flow").add_edge("view", "archive", 2.5).edges.select("source", "target", "weight")


@query("add_node", cte("event_flow") + " select source as id from event_flow union select target from event_flow union select 'archive'")
def _(s, d):
    return graph(s, d, "event_flow").add_node("archive").node_ids()


@query("remove_edge", cte("user_next") + ", m as (select min(target) t from user_next where source='U1') select source, target from user_next, m where not (source='U1' and target=t)")
def _(s, d):
    g = graph(s, d, "user_next")
    return g.remove_edge("U1", g.neighbors("U1").agg(F.min("id")).first()[0]).edges.select("source", "target")


@query("induced_edges", cte("cust_supp", "trade_vertices") + " select source, target, weight from cust_supp where source in (select id from trade_vertices where balance>5000) and target in (select id from trade_vertices where balance>5000)")
def _(s, d):
    return Graph(view(s, d, "trade_vertices"), view(s, d, "cust_supp")).filter_nodes("balance > 5000").edges.select("source", "target", "weight")


@query("paths_within_distance", PATHS_SQL.format(20, "and p.w+e.weight<=(select 2*max(weight) from event_flow)") + " select array_to_string(nodes, '>') as nodes, w as total_weight, depth::bigint as depth from p where s='view'")
def _(s, d):
    g = graph(s, d, "event_flow")
    most = 2 * g.edges.agg(F.max("weight")).first()[0]
    return paths.paths_within_distance(g, "view", most).withColumns({"nodes": F.array_join("nodes", ">"), "depth": F.col("depth").cast("long")})


@query("lightest_path", all_pairs_sql("nation_trade", 5) + " select s as source, t as target, round(w, 6) as total_weight, true as adds_up from w where s='N3' and t='N7'")
def _(s, d):
    g = graph(s, d, "nation_trade")
    path = paths.lightest_path(g, "N3", "N7")
    # the path's own edges must add up to its weight
    steps = path.select("total_weight", F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("source"), F.slice("nodes", 2, F.size("nodes") - 1).alias("target"))).alias("e")).select("total_weight", "e.source", "e.target")
    sums = steps.join(g.simple_edges().select("source", "target", "weight"), ["source", "target"]).groupBy("total_weight").agg((F.abs(F.sum("weight") - F.first("total_weight")) < 1e-6 * F.first("total_weight")).alias("adds_up"))
    return rounded(sums.select(F.lit("N3").alias("source"), F.lit("N7").alias("target"), "total_weight", "adds_up"))


# several graphs, further modes


for _mode, _sql in {"sum": "sum(weight)", "maximum": "max(weight)", "minimum": "min(weight)", "keep_first": "arg_min(weight, row(seq, graph_name, weight))"}.items():

    @query(f"multigraph_{_mode}", cte("priority_graphs") + f" select source, target, round({_sql}, 6) as weight, array_to_string(list_sort(list(distinct graph_name)), ',') as graph_name from priority_graphs group by 1,2")
    def _(s, d, mode=_mode):
        return rounded(multigraph.MultiGraph(view(s, d, "priority_graphs")).merge(combine=mode))


@query("multigraph_query", cte("priority_graphs") + " select source, target, weight, graph_name, seq from priority_graphs where graph_name in ('1-URGENT', '5-LOW') and weight>40")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).query(["1-URGENT", "5-LOW"], "weight > 40").select("source", "target", "weight", "graph_name", "seq")


@query("largest_graph", cte("priority_graphs") + " select graph_name, count(*) as edges from priority_graphs group by 1 order by 2 desc, 1 limit 1")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).largest()


@query("multigraph_nodes", cte("priority_graphs") + " select source as node_id from priority_graphs union select target from priority_graphs")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).all_nodes()


@query("graphs_containing", cte("priority_graphs") + " select distinct graph_name from priority_graphs where 'S1' in (source, target)")
def _(s, d):
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).graphs_containing("S1")


@query("overlapping_nodes", cte("priority_graphs") + ", n as (select graph_name g, source id from priority_graphs union select graph_name, target from priority_graphs) select id as node_id from n where g='1-URGENT' intersect select id from n where g='5-LOW'")
def _(s, d):
    names = [r[0] for r in view(s, d, "priority_graphs").select("graph_name").distinct().orderBy("graph_name").collect()]  # five priorities
    return multigraph.MultiGraph(view(s, d, "priority_graphs")).overlapping_nodes("1-URGENT" if "1-URGENT" in names else names[0], "5-LOW" if "5-LOW" in names else names[-1])


@query("degree_over_partition", cte("priority_graphs") + """, n as (select graph_name g, source id, 1 o from priority_graphs union all select graph_name, target, 0 from priority_graphs), k as (select g, id, sum(o) o from n group by 1,2)
  select g as part, id as node_id, round(case when count(*) over (partition by g)>1 then o/(count(*) over (partition by g)-1.0) else 0 end, 6) as score from k""")
def _(s, d):
    return rounded(centrality.windowed(graph(s, d, "priority_graphs"), "graph_name", "degree"))


@query("motif_shapes", cte("part_copurchase") + """, p as (select distinct least(source,target) a, greatest(source,target) b from part_copurchase where source<>target), s as (select a, b from p union all select b, a from p),
  w as (select distinct list_sort([x.a, x.b, y.b]) n from s x join s y on x.b=y.a and x.a<>y.b), c as (select (select count(*) from p where list_contains(n, a) and list_contains(n, b)) ne from w), z as (select 2 nv, 1 ne from p union all select 3, ne from c)
  select nv, ne::int as ne, count(*) as occurrences, round(count(*)/sum(count(*)) over (), 6) as support, ne=nv-1 as is_tree, ne=nv as is_cycle, ne*2=nv*(nv-1) as is_clique, nv>=3 as is_star, ne=nv-1 as is_path from z group by nv, ne""")
def _(s, d):
    return rounded(motifs.classify(motifs.motif_counts(graph(s, d, "part_copurchase"), 3)).drop("degrees"))


# triples, further filters


@query("triples_regex", cte("place_triples") + " select subject as s, object as n from place_triples where predicate='inNation' and regexp_matches(object, '^nation:NATION_1[0-9]$') and contains(subject, '#0')")
def _(s, d):
    return TripleStore(view(s, d, "place_triples")).select("s", "n").where(var("s"), "inNation", var("n")).filter("n", "regex", "^nation:NATION_1[0-9]$").filter("s", "contains", "#0").run()


@query("triples_distinct", cte("place_triples") + " select distinct object as n from place_triples where predicate='inNation' and object<>'nation:NATION_3'")
def _(s, d):
    return TripleStore(view(s, d, "place_triples")).select("n").where(var("s"), "inNation", var("n")).filter("n", "!=", "nation:NATION_3").distinct().run()


@query("ontology_instances", cte("place_triples") + " select distinct subject from place_triples where predicate='rdf:type' and object in ('Nation', 'Region')")
def _(s, d):
    return TripleStore(view(s, d, "place_triples")).add_class("Place").add_subclass("Nation", "Area").add_subclass("Region", "Area").add_subclass("Area", "Place").instances("Place")


# time, further


@query("temporal_snapshot", cte("user_next") + E.format(v="user_next") + ", m as (select min(timestamp) lo, max(timestamp) hi from e) select source, target, timestamp from e, m where timestamp<=lo+(hi-lo)//2 and timestamp>lo+(hi-lo)//2-86400*5")
def _(s, d):
    e = timed(view(s, d, "user_next")).select("source", "target", "timestamp")
    lo, hi = e.agg(F.min("timestamp"), F.max("timestamp")).first()
    return temporal.snapshot(e, lo + (hi - lo) // 2, 5 * temporal.DAY)


@query("recent_edges", cte("user_next") + E.format(v="user_next") + ", m as (select max(timestamp) hi from e) select source, target, timestamp from e, m where timestamp between hi-86400*2 and hi")
def _(s, d):
    e = timed(view(s, d, "user_next")).select("source", "target", "timestamp")
    return temporal.recent(e, e.agg(F.max("timestamp")).first()[0], 2)


@query("trend_directions", cte("daily_series") + SERIES + """, t as (select metric, coalesce(regr_slope(value,i),0) b, coalesce(corr(value,i),0) r, stddev_pop(value) v, avg(value) m, arg_min(value, i) f, arg_max(value, i) l from s group by 1)
  select metric, round(r*r,6) as r2, round(coalesce((l-f)/nullif(abs(f),0),0),6) as recent_change, case when abs(b)<0.01 then case when v>0.1*abs(m) then 'volatile' else 'stable' end when b>0 then 'increasing' else 'decreasing' end as direction from t""")
def _(s, d):
    return rounded(forecasting.trends(view(s, d, "daily_series")).select("metric", "r2", "recent_change", "direction"))


@query("overall_direction", cte("daily_series") + SERIES + """, t as (select coalesce(regr_slope(value,i),0) b, coalesce(corr(value,i),0)**2 r2 from s group by metric), v as (select sum(case when r2>0.5 then sign(b) else 0 end) v, avg(r2) r2 from t)
  select case when v>0 then 'increasing' when v<0 then 'decreasing' else 'stable' end as direction, round(coalesce(r2,0),6) as strength from v""")
def _(s, d):
    return rounded(forecasting.overall_direction(view(s, d, "daily_series")))


@query("forecast_band", cte("daily_series") + SERIES + ", m as (select metric, arg_max(value, ts) l, coalesce(regr_slope(value,i),0) b, stddev_pop(value) v from s group by 1), f as (select metric, k, greatest(0, l+b*k) x, v from m, range(1,4) r(k)) select metric, k::int as step, round(greatest(0, x-1.96*v),6) as low, round(x+1.96*v,6) as high from f")
def _(s, d):
    return rounded(forecasting.linear_forecast(view(s, d, "daily_series"), 3).select("metric", "step", "low", "high"))


@query("smoothing", cte("daily_series") + SERIES + ", m as (select metric, max(i) n from s group by 1) select s.metric, round(sum(pow(0.7, n-i)*value*case when i=0 then 1.0 else 0.3 end),6) as level from s join m on m.metric=s.metric group by 1")
def _(s, d):
    return rounded(forecasting.exponential_smoothing(view(s, d, "daily_series"), 0.3))


@query("rolling_features", cte("daily_series") + " select metric, ts, value, lag(value,7) over w as lag_7, round(avg(value) over (partition by metric order by ts rows 6 preceding),6) as mean_7, round(stddev_pop(value) over (partition by metric order by ts rows 6 preceding),6) as sd_7 from daily_series window w as (partition by metric order by ts)")
def _(s, d):
    return rounded(forecasting.lag_features(view(s, d, "daily_series"), (7,), (7,)).select("metric", "ts", "value", "lag_7", "mean_7", "sd_7"))


@query("series_patterns", cte("daily_series") + """, d as (select metric, value, (value>lag(value) over (partition by metric order by ts))::int up from daily_series), b as (select metric, avg(up) r, avg(value) m, stddev_pop(value) sd, max(value) t from d group by 1)
  select metric, 'growth' as pattern, round(r,6) as strength from b where r>0.7 union all select metric, 'burst', round(least(1.0, (t-m)/sd/4),6) from b where sd>0 and (t-m)/sd>2""")
def _(s, d):
    return rounded(forecasting.patterns(view(s, d, "daily_series")))


# changes between batches

CHANGES = "with b as (select user_id::varchar id, arg_min(event_type, (ts, event_id)) c0, arg_max(event_type, (ts, event_id)) c1 from events group by 1)"


def _states(s, d):
    """(before, now): each user's first and last event type."""
    e = table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("node_id"))
    order = F.struct("ts", "event_id")
    return e.agg(F.min_by("event_type", order).alias("community")), e.agg(F.max_by("event_type", order).alias("community"))


@query("community_stability", CHANGES + " select round(coalesce(avg((c0=c1)::int),1),6) as stability from b")
def _(s, d):
    return rounded(changes.stability(*_states(s, d)))


@query("changed_nodes", CHANGES + " select id as node_id, c0 as before, c1 as now from b where c0<>c1")
def _(s, d):
    return changes.changed_nodes(*_states(s, d))


@query("community_shift", CHANGES + ", t as (select avg((c0=c1)::int) x from b) select 7::bigint as batch, 'community_shift' as anomaly, round(1-x,6) as severity, round(1-x,6) as ratio from t where x<0.8")
def _(s, d):
    return rounded(changes.community_shift(*_states(s, d), 7))


BURSTS = "with h as (select floor(epoch_us(ts)/86400000000)::bigint batch, count(*) e, count(distinct user_id) v from events group by 1), a as (select batch, 'edge_burst' anomaly, least(1.0,e/10.0) severity, e/10.0 ratio from h where e>10 union all select batch, 'node_burst', least(1.0,v/5.0), v/5.0 from h where v>5)"


def _bursts(s, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (86_400 * MICRO)).cast("long")
    return changes.burst_anomalies(table(s, d, "events").groupBy(day.alias("batch")).agg(F.count(F.lit(1)).alias("edges_added"), F.count_distinct("user_id").alias("vertices_added")))


@query("burst_anomalies", BURSTS + " select batch, anomaly, round(severity,6) as severity, round(ratio,6) as ratio from a")
def _(s, d):
    return rounded(_bursts(s, d))


@query("change_classes", BURSTS + " select batch, 'scale' as change, round(avg(severity),6) as magnitude from a group by 1")
def _(s, d):
    return rounded(changes.classify_changes(_bursts(s, d)))


@query("structural_anomalies", cte("order_chain") + """, m as (select median(epoch_us(ts)) x from order_chain), e as (select source, target, epoch_us(ts)<=x early from order_chain, m), n as (select source id, early from e union all select target, early from e),
  k as (select id, count(*) filter (early) b, count(*) filter (not early) c from n group by 1)
  select 1::bigint as batch, case when c=0 then 'isolated_node' else 'hub_formation' end as anomaly, id as node_id, b as before, c as now from k where (b>0 and c=0) or (c>=2 and b<2)""")
def _(s, d):
    e = view(s, d, "order_chain").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    middle = e.agg(F.median("us")).first()[0]
    return changes.structural_anomalies(Graph.from_edges(e.where(F.col("us") <= middle)), Graph.from_edges(e.where(F.col("us") > middle)), 1, hub=2)


# streams and sketches, further


@query("windowed_statistics", """with e as (select cast(date_trunc('day', ts) as timestamp) s, event_type, value, user_id from events), u as (select s, event_type, user_id, count(*) c from e group by all), r as (select *, row_number() over (partition by s, event_type order by c desc, user_id) k from u)
  select e.s as start, e.event_type, count(*) as n, round(avg(value),6) as average, min(value) as minimum, max(value) as maximum, round(coalesce(stddev_samp(value),0),6) as stddev, round(median(value),6) as median, round(quantile_cont(value,0.95),6) as percentile_95, any_value(r.user_id) as mode
  from e join r on r.s=e.s and r.event_type=e.event_type and r.k=1 group by 1,2""")
def _(s, d):
    e = table(s, d, "events")
    out = windows.windowed_statistics(e, "1 day", "value", ("average", "minimum", "maximum", "stddev", "median", "percentile_95"), keys=("event_type",), exact=True, mode_of="user_id")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "average", "minimum", "maximum", "stddev", "median", "percentile_95", "mode"))


@query("interval_join", "select a.event_id as l_event_id, b.event_id as r_event_id from events a join events b on a.user_id=b.user_id and a.event_type='view' and b.event_type='purchase' and b.ts>=a.ts and b.ts<=a.ts + interval '6 hours'")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    return windows.interval_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "6 hours").select("l_event_id", "r_event_id")


@query("count_min_sound", "select user_id, true as sound from events group by 1")
def _(s, d):
    e = table(s, d, "events")
    truth = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    merged = sketches.CountMin.of(e.where("event_id % 2 = 0"), "user_id", width=2000).merge(sketches.CountMin.of(e.where("event_id % 2 <> 0"), "user_id", width=2000))
    return merged.estimate(e, "user_id").join(truth, "user_id").select("user_id", (F.col("estimate") >= F.col("n")).alias("sound"))


@query("distinct_within_bounds", "select true as close from (select 1)")
def _(s, d):
    e = table(s, d, "events")
    truth = e.agg(F.count_distinct("user_id")).first()[0]
    halves = [sketches.distinct_sketch(e.where(c), "user_id") for c in ("event_id % 2 = 0", "event_id % 2 <> 0")]
    return sketches.estimate_distinct(sketches.merge_distinct(halves[0].unionByName(halves[1]))).select((F.abs(F.col("estimate") - truth) <= 0.08 * truth + 1).alias("close"))


@query("triangle_sketch", "select true as close from (select 1)")
def _(s, d):
    g = graph(s, d, "user_next")
    found = triangles.triangle_count(g).first()["value"]
    t = motifs.subgraph_match(g, [("a", "b"), ("b", "c"), ("c", "a")])
    return sketches.estimate_distinct(sketches.triangle_sketch(t)).select((F.abs(F.col("estimate") - found) <= 0.08 * found + 1).alias("close"))


# walks and samples, by their properties


@query("walks_follow_edges", cte("user_next") + " select count(*)*2 as walks, true as follow from (select source id from user_next union select target from user_next)")
def _(s, d):
    g = graph(s, d, "user_next")
    w = walks.random_walk(g, 6, 2, seed=1)
    steps = w.select("walk_id", "step", F.col("node_id").alias("source")).join(w.select("walk_id", (F.col("step") - 1).alias("step"), F.col("node_id").alias("target")), ["walk_id", "step"])
    strays = steps.join(g.edges.select("source", "target").distinct(), ["source", "target"], "left_anti").count()
    return w.agg(F.count_distinct("walk_id").alias("walks")).withColumn("follow", F.lit(strays == 0))


for _by in ("uniform", "degree", "pagerank"):

    @query(f"sample_nodes_{_by}_size", cte("cust_supp") + " select count(*)//2 as n, true as inside from (select source id from cust_supp union select target from cust_supp)")
    def _(s, d, by=_by):
        g = graph(s, d, "cust_supp").settled()
        got = cut(sampling.sample_nodes(g, by=by, seed=2).distinct(), "sample")
        inside = got.join(g.node_ids().withColumnRenamed("id", "node_id"), "node_id", "left_anti").isEmpty()
        return got.agg(F.count(F.lit(1)).alias("n")).withColumn("inside", F.lit(inside))


@query("weisfeiler_lehman_sizes", cte("part_copurchase") + ", s as (select distinct source a, target b from part_copurchase where source<>target union select target, source from part_copurchase where source<>target), g as (select a, count(*) k from s group by 1), z as (select k, count(*) n from g group by 1) select 0 as round, sum(n)::bigint as n from z union all select 1, n from z")
def _(s, d):
    return similarity.weisfeiler_lehman(graph(s, d, "part_copurchase"), 1).select("round", "n")


@query("feature_importances", "select true as ranked from (select 1)")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_quantity") > 25).cast("int").alias("label"))
    got = modelling.importances(rows, ["quantity", "discount", "price"], "label")
    return got.where("place = 1").select((F.col("feature") == "quantity").alias("ranked"))
