"""Registered queries of the graph operators over the driver's whole tables, and their SQL.

Graphs: `tree` is region - nation - customer and supplier; `chain` links consecutive parts of an order; `next` links the
users of consecutive events of a day; `rates` links suppliers to parts with the mean quantity; `nations` is region - nation.

Loops run to their ends with the parameters that a user gets by default, in SQL as unrolled rounds that stand still from
the end on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import loomgraph as lg
from loomgraph.functions.edges import flipped
from loomgraph.names import DST, ID, SRC
from loomgraph.plans.store import Store
from loomgraph.sources.tables import frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GRAPH_SQL = {
    "tree": """select cast(r_regionkey as bigint) src, cast(100 + n_nationkey as bigint) dst, 'region_nation' as type from region join nation on n_regionkey = r_regionkey
        union all select cast(100 + c_nationkey as bigint), 10000 + c_custkey, 'nation_customer' from customer
        union all select cast(100 + s_nationkey as bigint), 10000000 + s_suppkey, 'nation_supplier' from supplier""",
    "chain": """select src, dst, type from (select l_partkey as src, l_returnflag as type, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where dst is not null""",
    "next": """select src, dst, type from (select user_id as src, event_type as type, lead(user_id) over (partition by date_trunc('day', ts) order by ts, event_id) as dst from events) where dst is not null""",
    "nations": "select cast(r_regionkey as bigint) src, cast(100 + n_nationkey as bigint) dst, n_name as type from region join nation on n_regionkey = r_regionkey",
    "rates": "select l_suppkey as src, 1000000 + l_partkey as dst, avg(l_quantity) as rating from lineitem group by 1, 2",
}


def edges_of(graph: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    if graph == "tree":
        nation = F.col("n_nationkey")
        first = read("region").join(read("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("bigint").alias(SRC), (100 + nation).cast("bigint").alias(DST), F.lit("region_nation").alias("type"))
        customers = read("customer").select((100 + F.col("c_nationkey")).cast("bigint"), (10000 + F.col("c_custkey")).cast("bigint"), F.lit("nation_customer"))
        suppliers = read("supplier").select((100 + F.col("s_nationkey")).cast("bigint"), (10000000 + F.col("s_suppkey")).cast("bigint"), F.lit("nation_supplier"))
        return first.union(customers).union(suppliers)
    if graph == "nations":
        return read("region").join(read("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("bigint").alias(SRC), (100 + F.col("n_nationkey")).cast("bigint").alias(DST), F.col("n_name").alias("type"))
    if graph == "chain":
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return read("lineitem").select(F.col("l_partkey").alias(SRC), F.lead("l_partkey").over(order).alias(DST), F.col("l_returnflag").alias("type")).where("dst is not null")
    if graph == "next":
        order = Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
        return read("events").select(F.col("user_id").alias(SRC), F.lead("user_id").over(order).alias(DST), F.col("event_type").alias("type")).where("dst is not null")
    return read("lineitem").groupBy(F.col("l_suppkey").alias(SRC), (1000000 + F.col("l_partkey")).cast("bigint").alias(DST)).agg(F.avg("l_quantity").alias("rating"))


def directed(graph: str, spark: SparkSession, sf_dir: str) -> lg.DirectedGraph:
    return lg.DirectedGraph(edges_of(graph, spark, sf_dir))


def undirected(graph: str, spark: SparkSession, sf_dir: str) -> lg.UndirectedGraph:
    return lg.UndirectedGraph(edges_of(graph, spark, sf_dir))


def query(name: str, sql: str | None = None, graph: str | None = None):
    """Registers a query; its SQL sees the graph as the view g, its distinct edges as e, its vertices as v."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = "" if graph is None else f"g as ({GRAPH_SQL[graph]}), e as (select distinct src, dst from g), v as (select src as id from g union select dst from g)"
            body = sql.strip()
            if head and body.startswith("with recursive"):
                body = f"with recursive {head}, {body[len('with recursive'):]}"
            elif head and body.startswith("with"):
                body = f"with {head}, {body[4:]}"
            elif head:
                body = f"with {head} {body}"
            ORACLE_SQL[name] = body
        return f

    return register


def rounds(first: str, step: str, n: int, last: str) -> str:
    """SQL of n unrolled rounds: CTEs t0 to t<n>, each made from the one before, which `step` calls {t}."""
    parts = [f"t0 as materialized ({first})"] + [f"t{k} as materialized ({step.format(t=f't{k - 1}')})" for k in range(1, n + 1)]
    return "with " + ", ".join(parts) + " " + last.format(t=f"t{n}")


BOTH = "(select src, dst from e union all select dst, src from e)"
SIMPLE = "(select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst)"
LINKS = f"(select a as src, b as dst from {SIMPLE} union all select b, a from {SIMPLE})"


# Graph construction and projections


@query("graph_counts", "select (select count(*) from v) as num_vertices, (select count(*) from g) as num_edges", "chain")
def graph_counts(spark, d):
    g = directed("chain", spark, d)
    return frame(spark, {"num_vertices": [g.num_vertices()], "num_edges": [g.num_edges()]})


@query("graph_rename", "select src, dst, type from g", "chain")
def graph_rename(spark, d):
    e = edges_of("chain", spark, d).withColumnsRenamed({SRC: "tail", DST: "head"})
    return lg.DirectedGraph(e, src_col="tail", dst_col="head").edges


@query("graph_vertices", "select id from v", "next")
def graph_vertices(spark, d):
    return directed("next", spark, d).vertices


@query("degrees", "select id, count(*) as degree from (select src as id from g union all select dst from g) group by id", "chain")
def degrees(spark, d):
    return undirected("chain", spark, d).degrees()


@query("directed_degrees", "select id, count(*) as degree from (select src as id from g union all select dst from g) group by id", "next")
def directed_degrees(spark, d):
    return directed("next", spark, d).degrees()


@query("out_degrees", "select src as id, count(dst) as degree from g group by src", "chain")
def out_degrees(spark, d):
    return directed("chain", spark, d).out_degrees()


@query("in_degrees", "select dst as id, count(src) as degree from g group by dst", "chain")
def in_degrees(spark, d):
    return directed("chain", spark, d).in_degrees()


@query("degree_by_type", "select id, type, count(*) as degree from (select src as id, type from g union all select dst, type from g) group by id, type", "next")
def degree_by_type(spark, d):
    return directed("next", spark, d).degree_by_type("type")


@query("triplets", """with n as (select cast(100 + n_nationkey as bigint) as id, n_name as label from nation union all select cast(r_regionkey as bigint), r_name from region
    union all select 10000 + c_custkey, c_name from customer)
    select src, dst, type, a.label as src_label, b.label as dst_label from g join n a on a.id = src join n b on b.id = dst""", "tree")
def triplets(spark, d):
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    named = read("nation").select((100 + F.col("n_nationkey")).cast("bigint").alias(ID), F.col("n_name").alias("label"))
    named = named.union(read("region").select(F.col("r_regionkey").cast("bigint"), "r_name")).union(read("customer").select(10000 + F.col("c_custkey"), "c_name"))
    return lg.DirectedGraph(edges_of("tree", spark, d), named).triplets()


@query("filter_vertices", "select src, dst, type from g where src % 3 <> 0 and dst % 3 <> 0", "chain")
def filter_vertices(spark, d):
    return directed("chain", spark, d).filter_vertices("id % 3 <> 0").edges


@query("filter_edges", "select src, dst, type from g where type = 'R' and src < dst", "chain")
def filter_edges(spark, d):
    return directed("chain", spark, d).filter_edges((F.col("type") == "R") & (F.col(SRC) < F.col(DST))).edges


@query("drop_isolated_vertices", "select distinct id from (select src as id from g where type = 'purchase' union all select dst from g where type = 'purchase')", "next")
def drop_isolated_vertices(spark, d):
    return directed("next", spark, d).filter_edges("type = 'purchase'").drop_isolated_vertices().vertices


@query("reverse", "select dst as src, src as dst, type from g", "next")
def reverse(spark, d):
    return directed("next", spark, d).reverse().edges


@query("as_undirected", "select src, dst, type from g union all select dst, src, type from g", "next")
def as_undirected(spark, d):
    return directed("next", spark, d).as_undirected().traversal_edges()


@query("as_directed", "select dst as src, src as dst, type from g", "next")
def as_directed(spark, d):
    return undirected("next", spark, d).as_directed(src_col=DST, dst_col=SRC).edges.select(SRC, DST, "type")


# Edge functions


@query("to_edges", "select o_custkey as src, o_orderkey as dst from orders")
def to_edges(spark, d):
    return lg.validate_edges(lg.to_edges(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderkey"))


@query("drop_self_loops", "select src, dst, type from g where src <> dst", "next")
def drop_self_loops(spark, d):
    return lg.drop_self_loops(edges_of("next", spark, d))


@query("dedupe_edges", "select src, dst from e", "chain")
def dedupe_edges(spark, d):
    return lg.dedupe_edges(edges_of("chain", spark, d))


@query("canonicalize", f"select a as src, b as dst from {SIMPLE}", "chain")
def canonicalize(spark, d):
    return lg.canonicalize(edges_of("chain", spark, d))


@query("symmetrize", "select src, dst, type from g union all select dst, src, type from g", "chain")
def symmetrize(spark, d):
    return lg.symmetrize(edges_of("chain", spark, d))


# Messages and loops


@query("aggregate_messages", "select id, cast(sum(x) as bigint) as msg from (select dst as id, src as x from g union all select src, dst from g) group by id", "chain")
def aggregate_messages(spark, d):
    e = edges_of("chain", spark, d)
    state = lg.DirectedGraph(e).vertices.select(ID, F.col(ID).alias("value"))
    return lg.aggregate_messages(e, state, to_dst=F.col("src_value"), to_src=F.col("dst_value"))


@query("aggregate_messages_max", "select dst as id, max(src) as msg from g group by dst", "next")
def aggregate_messages_max(spark, d):
    e = edges_of("next", spark, d)
    state = lg.DirectedGraph(e).vertices.select(ID, F.col(ID).alias("value"))
    return lg.aggregate_messages(e, state, to_dst=F.col("src_value"), agg=F.max)


@query("pregel_max", rounds("select id, id as value from v", "select id, greatest(value, coalesce(m, value)) as value from {t} left join (select dst, max(value) as m from e join {t} on id = src group by dst) on id = dst", 6, "select * from {t}"), "tree")
def pregel_max(spark, d):
    e = edges_of("tree", spark, d)
    state = lg.DirectedGraph(e).vertices.select(ID, F.col(ID).alias("value"))
    return lg.pregel(e, state, update=F.greatest("value", F.coalesce("msg", "value")), to_dst=F.col("src_value"), agg=F.max)


@query("fixed_point", "select 0 as n, 6 as rounds")
def fixed_point(spark, d):
    start = spark.createDataFrame([(5,)], "n int")
    end, n = lg.iterate_to_fixed_point(start, lambda s: s.select(F.greatest(F.col("n") - 1, F.lit(0)).alias("n")), lambda a, b: lg.same_rows(a, b, ["n"]))
    return end.select("n", F.lit(n).alias("rounds"))


# Components


_LEAST = ("select id, id as component from v", f"select {{t}}.id, least(component, coalesce(m, component)) as component from {{t}} left join (select dst, min(component) as m from {BOTH} b join {{t}} on id = src group by dst) on {{t}}.id = dst")


@query("connected_components", rounds(*_LEAST, 8, "select * from {t}"), "tree")
def connected_components(spark, d):
    return lg.connected_components(undirected("tree", spark, d), strategy="distributed")


@query("connected_components_chain", rounds(*_LEAST, 10, "select * from {t}"), "chain")
def connected_components_chain(spark, d):
    return lg.connected_components(undirected("chain", spark, d), strategy="distributed")


@query("connected_components_local", rounds(*_LEAST, 10, "select * from {t}"), "chain")
def connected_components_local(spark, d):
    return lg.connected_components(directed("chain", spark, d), strategy="local")


@query("large_star", f"with m as (select src, least(src, min(dst)) as m from {BOTH} group by src) select distinct b.dst as src, m as dst from {BOTH} b join m using (src) where b.dst > b.src", "next")
def large_star(spark, d):
    return lg.large_star(lg.dedupe_edges(edges_of("next", spark, d)))


@query("small_star", f"select b as src, a as dst from {SIMPLE}", "next")
def small_star(spark, d):
    return lg.small_star(edges_of("next", spark, d))


_REACH = "with recursive r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst)"


@query("strongly_connected_components", f"{_REACH} select v.id, least(v.id, coalesce(min(a.dst), v.id)) as component from v left join (select x.src, x.dst from r x join r y on x.src = y.dst and x.dst = y.src) a on a.src = v.id group by v.id", "next")
def strongly_connected_components(spark, d):
    return lg.strongly_connected_components(directed("next", spark, d), strategy="distributed")


@query("strongly_connected_components_dag", "select id, id as component from v", "tree")
def strongly_connected_components_dag(spark, d):
    return lg.strongly_connected_components(directed("tree", spark, d), strategy="distributed")


@query("strongly_connected_components_local", f"{_REACH} select v.id, least(v.id, coalesce(min(a.dst), v.id)) as component from v left join (select x.src, x.dst from r x join r y on x.src = y.dst and x.dst = y.src) a on a.src = v.id group by v.id", "next")
def strongly_connected_components_local(spark, d):
    return lg.strongly_connected_components(directed("next", spark, d), strategy="local")


@query("vertices_on_cycles", f"{_REACH} select distinct src as id from r where src = dst", "next")
def vertices_on_cycles(spark, d):
    return lg.vertices_on_cycles(directed("next", spark, d))


@query("has_cycle", "select false as tree, true as next")
def has_cycle(spark, d):
    found = [lg.has_cycle(directed(g, spark, d)) for g in ("tree", "next")]
    return spark.createDataFrame([tuple(found)], "tree boolean, next boolean")


# Ranks


def _rank_sql(start: str, n: int, extra: str = "") -> str:
    """Rounds of the power iteration; a walk whose ranks have moved by less than 1e-6 a vertex stays as it is."""
    walk, by = ("walk, ", "group by walk") if extra else ("", "")
    on = "t.walk = {0}.walk and ".format if extra else (lambda _: "")
    step = f"""select {'t.walk, ' if extra else ''}t.id, t.restart, t.rank as before,
        case when z.moved < 1e-6 * c.n then t.rank else 0.85 * (coalesce(s.heard, 0.0) + z.loose * t.restart) + 0.15 * t.restart end as rank
        from {{t}} t cross join c left join (select {'t.walk, ' if extra else ''}e.dst, sum(t.rank / o.n) as heard from {{t}} t join e on e.src = t.id join o on o.src = t.id group by all) s on {on('s')}s.dst = t.id
        join (select {walk}coalesce(sum(rank) filter (where not exists (select 1 from o where o.src = q.id)), 0.0) as loose, coalesce(sum(abs(rank - before)), 1e9) as moved from {{t}} q {by}) z on {on('z')}true"""
    body = rounds(start, step, n, f"select id, {'walk as source, ' if extra else ''}round(rank, 9) as rank from {{t}}")
    return "with o as (select src, count(*) as n from e group by src), c as (select count(*) as n from v), " + body[len("with ") :]


@query("pagerank", _rank_sql("select id, 1.0::double / c.n as restart, 1.0::double / c.n as rank, null::double as before from v, c", 60), "chain")
def pagerank(spark, d):
    return lg.pagerank(directed("chain", spark, d)).select(ID, F.round("rank", 9).alias("rank"))


@query("pagerank_personalized", _rank_sql("select id, case when id in (1, 3) then 0.5::double else 0.0::double end as restart, 1.0::double / c.n as rank, null::double as before from v, c", 60), "tree")
def pagerank_personalized(spark, d):
    return lg.pagerank(directed("tree", spark, d), source_ids=[1, 3, -7]).select(ID, F.round("rank", 9).alias("rank"))


@query("parallel_personalized_pagerank", _rank_sql("select w.walk, id, case when id = w.walk then 1.0::double else 0.0::double end as restart, 1.0::double / c.n as rank, null::double as before from v, c, (values (1::bigint), (2::bigint), (5::bigint)) w(walk)", 60, "walk, "), "next")
def parallel_personalized_pagerank(spark, d):
    return lg.parallel_personalized_pagerank(directed("next", spark, d), [1, 2, 5]).select(ID, "source", F.round("rank", 9).alias("rank"))


# Paths


_LEVELS = "with recursive l as (select {s}::bigint as id, 0 as hop union select step.dst, hop + 1 from l join {steps} step on step.src = l.id where hop < {n} and not exists (select 1 from l x where x.id = step.dst)), best as (select id, min(hop) as hop from l group by id)"


@query("bfs", """select p.pos, case p.pos when 0 then p.a when 1 then p.b when 2 then p.c else p.d end as id from (
    select x.pos, f.* from (select r2.src as a, n2.src as b, n2.dst as c, 0 as d from g n2 join g r2 on r2.dst = n2.src where n2.dst = 10001) f, (values (0), (1), (2)) x(pos)) p""", "tree")
def bfs(spark, d):
    g = directed("tree", spark, d)
    nation = g.edges.where("dst = 10001").first()[SRC]
    region = g.edges.where(F.col(DST) == nation).first()[SRC]
    path = lg.bfs(g, region, 10001)
    return spark.createDataFrame(list(enumerate(path)), "pos int, id bigint")


@query("all_shortest_paths", """with b as (select distinct src, dst from g where src <> dst),
    d as (select 1 as n from b where src = 1 and dst = 7 union all select 2 from b x join b y on x.dst = y.src where x.src = 1 and y.dst = 7), m as (select min(n) as n from d)
    select '1,7' as path from m where n = 1 union all select distinct '1,' || x.dst || ',7' from b x join b y on x.dst = y.src, m where m.n = 2 and x.src = 1 and y.dst = 7""", "next")
def all_shortest_paths(spark, d):
    return lg.all_shortest_paths_frame(directed("next", spark, d), 1, 7).select(F.array_join("path", ",").alias("path"))


@query("bfs_paths", """select a.src as from_id, a.type as e0, a.dst as v1, b.type as e1, b.dst as to_id from g a join g b on b.src = a.dst where a.src = 1 and b.type = 'nation_supplier'""", "tree")
def bfs_paths(spark, d):
    found = directed("tree", spark, d).bfs_paths("id = 1", "id >= 10000000")
    return found.select(F.col("`from`.id").alias("from_id"), F.col("e0.type").alias("e0"), F.col("v1.id").alias("v1"), F.col("e1.type").alias("e1"), F.col("to.id").alias("to_id"))


@query("bfs_paths_undirected", """with b as (select src, dst, type from g union all select dst, src, type from g)
    select a.src as from_id, a.dst as v1, c.dst as to_id from b a join b c on c.src = a.dst where a.src = 10001 and c.dst < 100""", "tree")
def bfs_paths_undirected(spark, d):
    found = undirected("tree", spark, d).bfs_paths("id = 10001", "id < 100")
    return found.select(F.col("`from`.id").alias("from_id"), F.col("v1.id").alias("v1"), F.col("to.id").alias("to_id"))


def _hops(n: int) -> str:
    step = "select landmark, id, min(hop) as hop from (select * from {t} union all select landmark, e.src, hop + 1 from {t} join e on e.dst = {t}.id) group by landmark, id"
    return rounds("select id as landmark, id, 0::bigint as hop from v where id in (1, 2, 10001, 50)", step, n, "select id, landmark, hop as distance from {t}")


@query("shortest_paths", _hops(8), "chain")
def shortest_paths(spark, d):
    return lg.shortest_paths(directed("chain", spark, d), [1, 2, 10001, 50])


@query("shortest_paths_undirected", _hops(8).replace("join e on", "join (select src, dst from e union select dst, src from e) e on"), "tree")
def shortest_paths_undirected(spark, d):
    return lg.shortest_paths(undirected("tree", spark, d), [1, 2, 10001, 50])


@query("all_paths", """select '1,7' as path from e where src = 1 and dst = 7 union all
    select '1,' || a.dst || ',7' from e a join e b on b.src = a.dst where a.src = 1 and b.dst = 7 and a.dst not in (1, 7) union all
    select '1,' || a.dst || ',' || b.dst || ',7' from e a join e b on b.src = a.dst join e c on c.src = b.dst where a.src = 1 and c.dst = 7 and a.dst not in (1, 7) and b.dst not in (1, 7) and a.dst <> b.dst""", "next")
def all_paths(spark, d):
    return lg.all_paths_frame(directed("next", spark, d), 1, 7, max_path_length=3).select(F.array_join("path", ",").alias("path"))


_MOVED = """select t.start, t.walk, coalesce(n.dst, t.at) as at, case when n.dst is null then t.path else t.path || ',' || n.dst end as path, t.step + 1 as step
    from {t} t left join f on f.src = t.at left join n on n.src = t.at
    and n.place = cast('0x' || substr(md5('1-' || t.start || '-' || t.walk || '-' || t.step), 1, 13) as bigint) % f.fan"""


@query("random_walks", "with n as (select src, dst, row_number() over (partition by src order by dst) - 1 as place from e), f as (select src, count(*) as fan from n group by src), "
    + rounds("select id as start, w.walk, id as at, id::varchar as path, 0 as step from v, (values (0), (1)) w(walk)", _MOVED, 5, "select start, walk, path from {t}")[len("with ") :], "next")
def random_walks(spark, d):
    return lg.random_walks_frame(directed("next", spark, d), walk_length=5, num_walks=2, seed=1).select("start", "walk", F.array_join("path", ",").alias("path"))


# Communities and structure


@query("label_propagation", rounds("select id, id as label from v", """select t.id, coalesce(h.label, t.label) as label from {t} t left join (
    select id, label from (select b.dst as id, s.label, row_number() over (partition by b.dst order by count(*) desc, s.label) as place
    from (select src, dst from g union all select dst, src from g) b join {t} s on s.id = b.src group by b.dst, s.label) where place = 1) h on h.id = t.id""", 10, "select * from {t}"), "next")
def label_propagation(spark, d):
    return lg.label_propagation(undirected("next", spark, d))


@query("power_iteration_clustering")
def power_iteration_clustering(spark, d):
    return lg.power_iteration_clustering(undirected("next", spark, d), 3)


@query("k_core", rounds(f"select id, coalesce(n, 0) as core from v left join (select src, count(*) as n from {LINKS} group by src) on src = id", f"""select t.id, least(t.core, coalesce(h.h, 0)) as core from {{t}} t left join (
    select id, max(least(core, place)) as h from (select l.dst as id, s.core, row_number() over (partition by l.dst order by s.core desc) as place from {LINKS} l join {{t}} s on s.id = l.src) group by id) h on h.id = t.id""", 60, "select * from {t}"), "chain")
def k_core(spark, d):
    return lg.k_core(undirected("chain", spark, d))


@query("triangle_count", f"""with s as {SIMPLE}, t as (select x.a as p, x.b as q, y.b as r from s x join s y on y.a = x.b join s z on z.a = x.a and z.b = y.b)
    select v.id, count(c.id) as triangle_count from v left join (select p as id from t union all select q from t union all select r from t) c on c.id = v.id group by v.id""", "chain")
def triangle_count(spark, d):
    return lg.triangle_count(undirected("chain", spark, d))


@query("maximal_independent_set", rounds("select id, 0 as state from v", f"""select t.id, case when t.state <> 0 then t.state when w.id is not null then 1 when l.id is not null then 2 else 0 end as state from {{t}} t
    left join (select a.id from {{t}} a where a.state = 0 and not exists (select 1 from {LINKS} k join {{t}} b on b.id = k.dst where k.src = a.id and b.state = 0 and b.id < a.id)) w on w.id = t.id
    left join (select distinct k.dst as id from {LINKS} k join (select a.id from {{t}} a where a.state = 0 and not exists (select 1 from {LINKS} k join {{t}} b on b.id = k.dst where k.src = a.id and b.state = 0 and b.id < a.id)) y on y.id = k.src) l on l.id = t.id""", 10, "select id, state = 1 as selected from {t}"), "next")
def maximal_independent_set(spark, d):
    return lg.maximal_independent_set(undirected("next", spark, d))


@query("hyper_anf", "with h as (select id, cast('0x' || substr(md5(cast(id as varchar)), 1, 13) as bigint) as h from v), s0 as (select id, h >> 46 as r, 47 - case when (h & 70368744177663) = 0 then 0 else length(ltrim(bin(h & 70368744177663), '0')) end as rho from h), "
    + ", ".join(f"s{k} as materialized (select id, r, max(rho) as rho from (select * from s{k - 1} union all select e.src, r, rho from s{k - 1} join e on e.dst = s{k - 1}.id) group by id, r)" for k in (1, 2, 3))
    + ", s as (" + " union all ".join(f"select {k}::bigint as hop, * from s{k}" for k in range(4)) + "), x as (select id, hop, 64 - count(*) as zeros, 0.709 * 64 * 64 / (sum(pow(2.0, -rho)) + 64 - count(*)) as raw from s group by id, hop) "
    + "select id, hop, round(case when raw <= 160 and zeros > 0 then 64 * ln(64.0 / zeros) else raw end, 6) as approx_count from x", "next")
def hyper_anf(spark, d):
    return lg.hyper_anf(directed("next", spark, d), max_hops=3, precision=6).select(ID, "hop", F.round("approx_count", 6).alias("approx_count"))


def _svd_sql(rank: int = 4, epochs: int = 20, rate: float = 0.01, reg: float = 0.05, seed: int = 0) -> str:
    """The epochs of the damped sums of gradients, unrolled."""
    each = range(rank)
    cols = lambda form: ", ".join(form.format(k=k) for k in each)
    hexed = lambda side, k, j: f"cast('0x' || substr(md5({side} || '-{k}-{seed}-{j}'), 1, 8) as bigint)::double"
    normal = lambda side, k: f"(({' + '.join(hexed(side, k, j) for j in range(3))}) / 4294967296.0::double - 1.5) * 0.2::double"
    guess = "r.r - m.mean - a.bu - b.bi - (" + " + ".join(f"b.q{k} * (a.p{k} + z.z{k})" for k in each) + ")"
    square = lambda form: " + ".join(f"pow({form.format(k=k)}, 2)" for k in each)
    moved = lambda now, g, n: f"{now} + step * ({g} - {reg}::double * {n} * {now}) as {now}"
    stepped = lambda c: f"{rate}::double / (1 + {rate}::double * ({c})) as step"
    errors = lambda a, b, z: f"(select r.u, r.i, {guess} as e, {cols('a.p{k}, b.q{k}, z.z{k}')} from r join {a} a using (u) join {b} b using (i) join {z} z using (u), m)"
    implied = lambda b: f"select u, {cols('sum(y{k}) / sqrt(count(*)) as z{k}')} from r join {b} using (i) group by u"
    ys = cols("y{k}")
    parts = [
        "r as materialized (select src as u, dst as i, rating as r from g)",
        "m as materialized (select avg(r) as mean from r)",
        f"a0 as materialized (select u, count(*) as nu, 0.0::double as bu, {', '.join(f'{normal('u', k)} as p{k}' for k in each)} from r group by u)",
        f"b0 as materialized (select i, count(*) as ni, sum(nu) as near, 0.0::double as bi, {', '.join(f'{normal('i', 100 + k)} as q{k}, {normal('i', 200 + k)} as y{k}' for k in each)} from r join a0 using (u) group by i)",
        f"z0 as materialized ({implied('b0')})",
    ]
    for t in range(epochs):
        parts += [
            f"g{t} as materialized (select a.*, {stepped('nu + 2 * curve')}, ge, {cols('g{k}')} from a{t} a join (select u, sum(e) as ge, sum({square('q{k}')}) as curve, {cols('sum(e * q{k}) as g{k}')} from {errors(f'a{t}', f'b{t}', f'z{t}')} group by u) using (u))",
            f"a{t + 1} as materialized (select u, nu, {moved('bu', 'ge', 'nu')}, {', '.join(moved(f'p{k}', f'g{k}', 'nu') for k in each)} from g{t})",
            f"c{t} as materialized (select b.* exclude ({ys}), {', '.join(f'y{k} + w{k} / near - {rate}::double * {reg}::double * y{k} as y{k}' for k in each)} from b{t} b join (select r.i, {cols('sum(sqrt(nu) * step * g{k}) as w{k}')} from r join g{t} using (u) group by r.i) using (i))",
            f"z{t + 1} as materialized ({implied(f'c{t}')})",
            f"b{t + 1} as materialized (select i, ni, near, {moved('bi', 'ge', 'ni')}, {', '.join(moved(f'q{k}', f'g{k}', 'ni') for k in each)}, {ys} from (select c.*, {stepped('ni + curve')}, ge, {cols('g{k}')} from c{t} c join (select i, sum(e) as ge, sum({square('p{k} + z{k}')}) as curve, {cols('sum(e * (p{k} + z{k})) as g{k}')} from {errors(f'a{t + 1}', f'c{t}', f'z{t + 1}')} group by i) using (i)))",
        ]
    return f"with {', '.join(parts)} select u as id, 'user' as kind, round(bu, 7) as bias, round(p0, 7) as first from a{epochs} union all select i, 'item', round(bi, 7), round(q0, 7) from b{epochs}"


@query("svd_plus_plus", _svd_sql(), "rates")
def svd_plus_plus(spark, d):
    return lg.svd_plus_plus(directed("rates", spark, d), rank=4).factors.select(ID, "kind", F.round("bias", 7).alias("bias"), F.round(F.col("factor")[0], 7).alias("first"))


@query("svd_plus_plus_distributed", _svd_sql(epochs=2), "rates")
def svd_plus_plus_distributed(spark, d):
    """Two epochs, as each takes several jobs; the loop is the same for any number."""
    return lg.svd_plus_plus(directed("rates", spark, d), rank=4, epochs=2, strategy="distributed").factors.select(ID, "kind", F.round("bias", 7).alias("bias"), F.round(F.col("factor")[0], 7).alias("first"))


# Motifs


@query("find_one_way", "select g.src as a, g.dst as b, g.type as e_type from g join e using (src, dst) join (select src, dst, count(*) as k from g group by all) m using (src, dst), generate_series(1, m.k) where not exists (select 1 from g r where r.src = g.dst and r.dst = g.src) and g.src <> -1", "next")
def find_one_way(spark, d):
    found = directed("next", spark, d).find("(a)-[e]->(b); !(b)-[]->(a)")
    return found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("e.type").alias("e_type"))


@query("find_path", "select x.src as a, x.dst as b, y.dst as c from g x join g y on y.src = x.dst", "tree")
def find_path(spark, d):
    found = directed("tree", spark, d).find("(a)-[]->(b); (b)-[]->(c)")
    return found.select(*[F.col(f"{n}.id").alias(n) for n in "abc"])


@query("find_triangle", "select x.src as a, x.dst as b, y.dst as c from e x join e y on y.src = x.dst join e z on z.src = y.dst and z.dst = x.src", "next")
def find_triangle(spark, d):
    g = lg.DirectedGraph(lg.dedupe_edges(edges_of("next", spark, d)))
    return g.find("(a)-[]->(b); (b)-[]->(c); (c)-[]->(a)").select(*[F.col(f"{n}.id").alias(n) for n in "abc"])


@query("find_disconnected", "select v.id as a, g.src as b, g.dst as c from v, g", "nations")
def find_disconnected(spark, d):
    found = directed("nations", spark, d).find("(a); (b)-[]->(c)")
    return found.select(*[F.col(f"{n}.id").alias(n) for n in "abc"])


# Ids


@query("reindex", "with m as (select n_name as original_id, row_number() over (order by n_name) - 1 as id from (select n_name from nation union select r_name from region)) select a.id as src, b.id as dst from region join nation on n_regionkey = r_regionkey join m a on a.original_id = r_name join m b on b.original_id = n_name")
def reindex(spark, d):
    e = spark.read.parquet(f"{d}/region.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lg.reindex(lg.DirectedGraph(e.select(F.col("r_name").alias(SRC), F.col("n_name").alias(DST)))).graph.edges


@query("reindex_mapping", "select p_name as original_id, row_number() over (order by p_name) - 1 as id from (select distinct p_name from part)")
def reindex_mapping(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias(ID)).distinct()
    return lg.reindex(lg.DirectedGraph(names.select(F.col(ID).alias(SRC), F.col(ID).alias(DST)), names)).mapping


@query("restore_ids", "select r_name as id, r_name as component from region union select n_name, least(r_name, m) from nation join region on n_regionkey = r_regionkey join (select n_regionkey as k, min(n_name) as m from nation group by 1) on k = r_regionkey")
def restore_ids(spark, d):
    e = spark.read.parquet(f"{d}/region.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    indexed = lg.reindex(lg.UndirectedGraph(e.select(F.col("r_name").alias(SRC), F.col("n_name").alias(DST))))
    return lg.restore_ids(lg.connected_components(indexed.graph), indexed.mapping, [ID, "component"])


# Tables


@query("same_rows", "select true as same, false as other")
def same_rows(spark, d):
    e = lg.dedupe_edges(edges_of("next", spark, d))
    return spark.createDataFrame([(lg.same_rows(e, e.union(e), [SRC, DST]), lg.same_rows(e, flipped(e), [SRC, DST]))], "same boolean, other boolean")


@query("read_table", "select n_nationkey, n_name, n_regionkey from nation")
def read_table(spark, d):
    from loomgraph.sources.tables import read_table as read

    return read(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("write_table", "select src, dst, type from g", "next")
def write_table(spark, d):
    from loomgraph.sources.tables import read_table as read
    from loomgraph.sources.tables import write_table as write

    path = f"{Store(spark).path}/edges"
    write(edges_of("next", spark, d), path, partition_by=["type"])
    return read(spark, path).select(SRC, DST, "type")


@query("read_edge_list", "select src, dst from g", "next")
def read_edge_list(spark, d):
    from loomgraph.sources.tables import read_edge_list as read

    path = f"{Store(spark).path}/edges"
    lines = edges_of("next", spark, d).select(F.concat_ws("\t", SRC, DST).alias("value"))
    lines.union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.option("compression", "gzip").text(path)
    return read(spark, path)


@query("read_catalog", "select src, dst, type from g", "nations")
def read_catalog(spark, d):
    from loomgraph.sources.tables import read_catalog as read

    edges_of("nations", spark, d).createOrReplaceTempView("loomgraph_nations")
    return read(spark, "loomgraph_nations")


@query("validated_graph", "select src, dst, type from g", "tree")
def validated_graph(spark, d):
    g = directed("tree", spark, d)
    return lg.DirectedGraph(lg.validate_edges(g.edges), g.vertices, validate=True).edges


@query("is_directed", "select true as directed, false as undirected")
def is_directed(spark, d):
    return frame(spark, {"directed": [directed("nations", spark, d).is_directed], "undirected": [undirected("nations", spark, d).is_directed]})


@query("connected_components_auto", rounds(*_LEAST, 10, "select * from {t}"), "chain")
def connected_components_auto(spark, d):
    return lg.connected_components(undirected("chain", spark, d))
