"""Driver queries: the operators over a network of nations that the order tables describe.

Nodes are nations, named region/nation; links carry what suppliers of one nation shipped to
customers of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import expand_brackets, number_key_column
from .model import CHILDREN, GROUPS, LINKS, MEMBERS, NODES, Network
from .operators import aggregate as ag
from .operators import demand as dm
from .operators import failure as fl
from .operators import hardware as hw
from .operators import paths, topology
from .operators.select import find_links, links_between, match_ids, select_nodes
from .plans.analysis import Analysis

ND = """nd as (select r_name || '/' || n_name as name, cast(n_nationkey as bigint) k, n_nationkey % 11 = 7 as disabled, r_name as region
  from nation join region on n_regionkey = r_regionkey)"""
LK = """lk as (select s.name || '|' || t.name || '|0' as link_id, s.name as source, t.name as target, cast(round(sum(l_quantity)) as double) as capacity,
  cast(1 + (s.k * 7 + t.k * 3) % 10 as double) as cost, (s.k + t.k) % 17 = 0 as disabled, s.k as sk, t.k as tk
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nd s on s.k = s_nationkey join nd t on t.k = c_nationkey where s.k <> t.k group by s.name, t.name, s.k, t.k)"""
AL = "al as (select lk.* from lk join nd a on a.name = source join nd b on b.name = target where not lk.disabled and not a.disabled and not b.disabled)"
# Least costs between all live nodes, over 1, 2, 4, ... 32 edges: no path of least cost is longer.
COSTS = [
    "e as (select source src, target dst, cast(cost as bigint) w, link_id from al union all select target, source, cast(cost as bigint), link_id from al)",
    "d1 as (select origin, node, min(c) as cost from (select name origin, name node, cast(0 as bigint) c from nd where not disabled union all select src, dst, w from e) group by 1, 2)",
    *(f"d{2 * n} as (select x.origin, y.node, min(x.cost + y.cost) as cost from d{n} x join d{n} y on x.node = y.origin group by 1, 2)" for n in (1, 2, 4, 8, 16)),
]
BOTH = "e as (select source src, target dst, * from lk union all select target src, source dst, * from lk)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("long")
    attrs = F.to_json(F.struct(F.col("r_name").alias("region"), k.alias("key"), (k % 3).alias("tier"), (k % 2 == 0).alias("even"), F.array(F.concat(F.lit("t"), k % 4), F.lit("all")).alias("tags"), F.struct(F.concat(F.lit("site"), k % 5).alias("code")).alias("site"), F.when(k % 6 != 0, F.concat(F.lit("v"), k % 2)).alias("vendor")))
    return n.select(F.concat_ws("/", "r_name", "n_name").alias("name"), (k % 11 == 7).alias("disabled"), F.array(F.concat(F.lit("rg"), k % 4)).alias("risk_groups"), attrs.alias("attrs"), k.alias("node_ord"))


def nation_links(spark: SparkSession, sf: str) -> DataFrame:
    names = F.broadcast(nation_nodes(spark, sf).select("name", F.col("node_ord").alias("k")))
    supplier = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("sk"))
    customer = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("tk"))
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(supplier, "l_suppkey")
    total = lines.join(orders, "l_orderkey").filter("sk <> tk").groupBy("sk", "tk").agg(F.round(F.sum("l_quantity")).cast("double").alias("capacity"))
    out = total.join(names.select(F.col("name").alias("source"), F.col("k").alias("sk")), "sk").join(names.select(F.col("name").alias("target"), F.col("k").alias("tk")), "tk")
    return out.select(F.concat_ws("|", "source", "target", F.lit(0)).alias("link_id"), "source", "target", "capacity", (1 + (F.col("sk") * 7 + F.col("tk") * 3) % 10).cast("double").alias("cost"), ((F.col("sk") + F.col("tk")) % 17 == 0).alias("disabled"), F.array(F.concat(F.lit("lane"), F.col("sk") % 3)).alias("risk_groups"), F.to_json(F.struct(F.col("sk"), F.col("tk"))).alias("attrs"), (F.col("sk") * 1000 + F.col("tk")).alias("link_ord"))


def nation_network(spark: SparkSession, sf: str) -> Network:
    make = spark.createDataFrame
    # Collected once: kernels need it whole, and nations bound its size.
    nodes, links = (make(df.collect(), s) for df, s in ((nation_nodes(spark, sf), NODES), (nation_links(spark, sf), LINKS)))
    return Network(nodes, links, make([], GROUPS), make([], CHILDREN), make([], MEMBERS))


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("with " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


@query("""select (select count(*) from al) link_count, (select coalesce(sum(capacity), 0) from al) total_capacity, (select avg(cost) from al) mean_cost, (select median(capacity) from al) median_capacity,
 (select min(capacity) from al) min_capacity, (select max(cost) from al) max_cost, (select count(*) from nd where not disabled) node_count""", ND, LK, AL)
def network_stats(spark, sf):
    s = ag.network_stats(nation_nodes(spark, sf), nation_links(spark, sf))
    return s.select("link_count", "total_capacity", "mean_cost", "median_capacity", "min_capacity", "max_cost", "node_count")


@query("select name, cast(count(x) as bigint) degree from nd left join (select source x from al union all select target from al) on x = name where not disabled group by name", ND, LK, AL)
def degrees(spark, sf):
    return ag.degrees(*ag.alive(nation_nodes(spark, sf), nation_links(spark, sf)))


@query("select link_id, 'fwd' direction, source src, target dst, capacity, cost from al union all select link_id, 'rev', target, source, capacity, cost from al", ND, LK, AL)
def active_edges(spark, sf):
    return topology.active_edges(nation_links(spark, sf), nation_nodes(spark, sf))


@query("select regexp_extract(name, '^([A-Z ]+)/([A-Z])', 1) || '|' || regexp_extract(name, '^([A-Z ]+)/([A-Z])', 2) label, name from nd where not disabled and regexp_matches(name, '^([A-Z ]+)/([A-Z])')", ND)
def select_by_capture_group(spark, sf):
    return select_nodes(nation_nodes(spark, sf), "([A-Z ]+)/([A-Z])").select("label", "name")


def _cond(attr, op, value=None):
    return {"attr": attr, "op": op, "value": value}


@query("select name from nd where k % 3 = 1 and k >= 5 and k <> 7", ND)
def select_match_and(spark, sf):
    return match_ids(nation_nodes(spark, sf), "name", [_cond("tier", "==", 1), _cond("key", ">=", "5"), _cond("key", "!=", 7)])


@query("select name from nd where k % 3 = 2 or region = 'ASIA' or k < 3", ND)
def select_match_or(spark, sf):
    return match_ids(nation_nodes(spark, sf), "name", [_cond("tier", "==", 2), _cond("region", "==", "ASIA"), _cond("key", "<", 3)], "or")


@query("select name from nd where k % 5 in (1, 3) and k not in (3, 6)", ND)
def select_in_not_in(spark, sf):
    return match_ids(nation_nodes(spark, sf), "name", [_cond("site.code", "in", ["site1", "site3"]), _cond("key", "not_in", [3, 6])])


@query("select name from nd where k % 4 = 2 and contains(region, 'A') and k % 2 = 0", ND)
def select_contains(spark, sf):
    return match_ids(nation_nodes(spark, sf), "name", [_cond("tags", "contains", "t2"), _cond("region", "contains", "A"), _cond("tags", "not_contains", "t3"), _cond("even", "==", True)])


@query("select name, k % 6 <> 0 as has_vendor from nd", ND)
def select_exists(spark, sf):
    n = nation_nodes(spark, sf)
    a = match_ids(n, "name", [_cond("vendor", "exists")]).withColumn("has_vendor", F.lit(True))
    return a.unionByName(match_ids(n, "name", [_cond("vendor", "not_exists")]).withColumn("has_vendor", F.lit(False)))


@query("select case when k % 2 = 0 then 'True' else 'False' end as label, name from nd where not disabled", ND)
def select_group_by(spark, sf):
    return select_nodes(nation_nodes(spark, sf), {"group_by": "even"}).select("label", "name")


@query("select link_id from lk where (regexp_matches(source, 'ASIA') and regexp_matches(target, 'EUROPE/NATION_[38]')) or (regexp_matches(source, 'EUROPE/NATION_[38]') and regexp_matches(target, 'ASIA'))", ND, LK)
def find_links_any_direction(spark, sf):
    return find_links(nation_links(spark, sf), "ASIA", "EUROPE/NATION_[38]", True).select("link_id")


@query("select link_id, capacity from lk where source = 'ASIA/' || (select min(split_part(name, '/', 2)) from nd where region = 'ASIA') and target like 'EUROPE/%'", ND, LK)
def links_from_first_asian(spark, sf):
    links, nodes = nation_links(spark, sf), nation_nodes(spark, sf)
    first = nodes.filter("name like 'ASIA/%'").agg(F.min("name").alias("source"))
    return links.filter("target like 'EUROPE/%'").join(F.broadcast(first), "source").select("link_id", "capacity")


@query("select least(s.name, t.name) as a, greatest(s.name, t.name) as b from nd s join nd t on s.k < t.k and s.region = 'ASIA' and t.region = 'ASIA'", ND)
def mesh_links(spark, sf):
    asia = select_nodes(nation_nodes(spark, sf), "ASIA/.*", "adjacency")
    return topology.mesh(asia, asia).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))


@query("""select s.name source, t.name target from (select name, row_number() over (order by k) - 1 i from nd where region = 'ASIA') s
 join (select name, row_number() over (order by k) - 1 i from nd where region = 'EUROPE') t on s.i = t.i""", ND)
def one_to_one_links(spark, sf):
    n = nation_nodes(spark, sf)
    return topology.one_to_one(select_nodes(n, "ASIA/.*", "adjacency"), select_nodes(n, "EUROPE/.*", "adjacency")).select("source", "target")


@query("select s.name || '|' || t.name || '|' || i as link_id, cast(40 as double) capacity from nd s, nd t, range(3) r(i) where s.region = 'ASIA' and t.region = 'AFRICA'", ND)
def parallel_links(spark, sf):
    n = nation_nodes(spark, sf)
    return topology.parallel(topology.mesh(select_nodes(n, "ASIA/.*", "adjacency"), select_nodes(n, "AFRICA/.*", "adjacency")), 3, 40.0).select("link_id", "capacity")


@query("select 'dc' || a || '_' || b as name from (values (1), (2), (3), (7)) x(a), (values ('p'), ('q')) y(b)")
def bracket_expand(spark, sf):
    return spark.createDataFrame([(x,) for x in expand_brackets("dc[1-3,7]_[p,q]")], "name string")


@query("""select link_id, case when h then 99.0 else capacity end as capacity, case when h then 3.0 else cost end as cost from
 (select *, cost > 4 and ((source like 'ASIA/%' and target like 'EUROPE/%') or (source like 'EUROPE/%' and target like 'ASIA/%')) h from lk)""", ND, LK)
def link_rule_override(spark, sf):
    rule = {"source": "ASIA/.*", "target": "EUROPE/.*", "capacity": 99, "cost": 3, "link_match": {"conditions": [_cond("cost", ">", 4)]}}
    return topology.link_rules(nation_links(spark, sf), nation_nodes(spark, sf), [rule]).select("link_id", "capacity", "cost")


@query("select name, disabled or region = 'AFRICA' as disabled, case when region = 'AFRICA' then 'x,y' else 'rg' || (k % 4) end as groups from nd", ND)
def node_rule_override(spark, sf):
    rule = {"path": "AFRICA/", "disabled": True, "risk_groups": ["y", "x"]}
    return topology.node_rules(nation_nodes(spark, sf), [rule]).select("name", "disabled", F.array_join("risk_groups", ",").alias("groups"))


@query("select s.name src, t.name dst, cast(1200.0 as double) / (select count(*) from nd a, nd b where a.region = 'ASIA' and b.k % 3 = 1 and not a.disabled and not b.disabled and a.k <> b.k) volume from nd s, nd t where s.region = 'ASIA' and t.k % 3 = 1 and not s.disabled and not t.disabled and s.k <> t.k", ND)
def demand_pairwise(spark, sf):
    n = nation_nodes(spark, sf)
    return dm.pairwise(select_nodes(n, "ASIA/.*", "demand"), select_nodes(n, {"match": {"conditions": [_cond("tier", "==", 1)]}}, "demand"), 1200).select("src", "dst", "volume")


@query("select s.region src_label, t.region dst_label, cast(100 as double) volume from (select distinct region from nd where not disabled) s, (select distinct region from nd where not disabled) t where s.region <> t.region", ND)
def demand_per_group(spark, sf):
    g = select_nodes(nation_nodes(spark, sf), "([A-Z ]+)/", "demand")
    return dm.grouped(g, g, 100, False)


@query("select src_label, dst_label, count(*) n, round(sum(volume), 6) volume from (select s.region src_label, t.region dst_label, cast(100 as double) / 20 / count(*) over (partition by s.region, t.region) volume from nd s, nd t where not s.disabled and not t.disabled and s.region <> t.region) group by all", ND)
def demand_group_pairwise(spark, sf):
    g = select_nodes(nation_nodes(spark, sf), "([A-Z ]+)/", "demand")
    return dm.grouped_pairwise(g, g, 100, True).groupBy("src_label", "dst_label").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("volume"))


@query("select '__PSEUDO_SRC_' || region || '__' src, name dst, cast(1e15 as double) capacity, cast(0 as double) as cost from nd where not disabled and region < 'B' union all select name, '__PSEUDO_SNK_' || region || '__', 1e15, 0 from nd where not disabled and region > 'B'", ND)
def pseudo_edges(spark, sf):
    n = nation_nodes(spark, sf)
    return topology.pseudo_edges(select_nodes(n, "(A[A-Z ]+)/"), select_nodes(n, "([B-Z][A-Z ]+)/"), "pairwise")


@query("select 'site_' || 'site' || (k % 5) as \"group\", count(*) n from nd group by 1", ND)
def rg_generate(spark, sf):
    return fl.generate_groups(nation_nodes(spark, sf), "name", "site.code", "site_${value}").groupBy("group").agg(F.count("*").alias("n"))


@query("select 'fast' as \"group\", link_id entity from lk where cost <= 3 and capacity > 0", ND, LK)
def rg_membership(spark, sf):
    return fl.membership(nation_links(spark, sf), "link_id", "fast", [_cond("cost", "<=", 3), _cond("capacity", ">", 0)])


@query("select name entity, 'rg' || (k % 4) as \"group\" from nd where k % 4 > 1", ND)
def rg_undefined_refs(spark, sf):
    return fl.undefined_groups(nation_nodes(spark, sf), "name", spark.createDataFrame([("rg0",), ("rg1",)], "name string"))


@query("select 'p' || c_custkey as \"group\" from customer where false union all select * from (with recursive d(k) as (select 0 union select c.k from (select cast(p_partkey as bigint) k, cast((p_partkey - 1) // 3 as bigint) p from part where p_partkey > 0) c join d on c.p = d.k) select 'g' || k from d)")
def rg_descendants(spark, sf):
    part = read(spark, sf, "part")
    kids = part.select(F.concat(F.lit("g"), F.floor((F.col("p_partkey") - 1) / 3)).alias("parent"), F.concat(F.lit("g"), F.col("p_partkey")).alias("child"))
    return fl.descendants(kids, ["g0"])


@query("""select * from (with recursive m as (select 'c' || o_custkey entity, 'g' || (o_orderkey % 997) as g from orders),
 r(entity) as (select min(entity) from m union select b.entity from r join m a on a.entity = r.entity join m b on b.g = a.g) select entity from r)""")
def shared_risk(spark, sf):
    m = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("entity"), F.concat(F.lit("g"), F.col("o_orderkey") % 997).alias("group")).distinct()
    first = m.agg(F.min("entity").alias("e")).first().e
    return fl.shared_risk(m, [first] if first else [])


@query("select p_partkey, cast(sum(greatest(p_size - 10, 0)) over (order by p_partkey) as bigint) upto from part")
def mode_pick_cumulative(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") - 10).cast("long").alias("w"))
    return fl.cumulative_weights(p, "p_partkey", "w").select("p_partkey", "upto")


@query("select p_partkey from (select p_partkey, case when p_size % 7 > 0 then pow(((p_partkey * 7919) % 10007 + 1) / 10009.0, 1.0 / (p_size % 7)) else -1.0 end s from part) order by s desc, p_partkey limit 20")
def weighted_topk_choice(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).cast("double").alias("w"), (((F.col("p_partkey") * 7919) % 10007 + 1) / 10009.0).alias("u"))
    return fl.weighted_top_k(p, "p_partkey", "u", "w", 20).select("p_partkey")


@query("select link_id from al where split_part(source, '/', 1) <> 'ASIA' and split_part(target, '/', 1) <> 'ASIA'", ND, LK, AL)
def exclusions_antijoin(spark, sf):
    nodes = nation_nodes(spark, sf)
    gone = nodes.filter("name like 'ASIA/%'").select("name")
    left = nodes.join(gone, "name", "left_anti")
    return ag.alive(left, nation_links(spark, sf))[1].select("link_id")


@query("select n excluded, count(*) occurrence_count, min(o_orderkey) first_iteration from (select o_orderkey, 'c' || (o_custkey % 5) || ',' || 'p' || substr(o_orderpriority, 1, 1) n from orders) group by n")
def pattern_dedup(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("iteration"), F.array(F.concat(F.lit("c"), F.col("o_custkey") % 5), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))).alias("excluded_nodes"), F.array().cast("array<string>").alias("excluded_links"), F.lit("").alias("trace"))
    return fl.distinct_patterns(o).select(F.array_join("excluded_nodes", ",").alias("excluded"), "occurrence_count", F.col("first_iteration"))


FLOWS = "fw as (select event_type source, cast(user_id % 7 as bigint) destination, cast(floor(value) as bigint) v, event_id from events where value is not null)"


def event_flows(spark, sf):
    return read(spark, sf, "events").filter("value is not null").select(F.col("event_type").alias("source"), (F.col("user_id") % 7).alias("destination"), F.floor("value").alias("v"), "event_id")


@query("select source, destination, count(*) total_samples, min(v) min_value, max(v) max_value, round(avg(v), 6) mean_value, round(stddev_pop(v), 5) stdev_value from fw group by 1, 2", FLOWS)
def capacity_envelope(spark, sf):
    e = ag.envelope(ag.frequencies(event_flows(spark, sf), ["source", "destination"], "v"), ["source", "destination"])
    return e.withColumn("mean_value", F.round("mean_value", 6)).withColumn("stdev_value", F.round("stdev_value", 5))


@query("select source, destination, quantile_disc(v, 0.5) percentile from fw group by 1, 2", FLOWS)
def envelope_percentile(spark, sf):
    return ag.envelope_percentile(ag.frequencies(event_flows(spark, sf), ["source", "destination"], "v"), ["source", "destination"], 50)


@query("select source, edge, count(*) n from (select source, unnest(['d' || destination, 'v' || (v % 5)]) edge from fw) group by 1, 2", FLOWS)
def min_cut_frequency(spark, sf):
    cuts = event_flows(spark, sf).select("source", F.array(F.concat(F.lit("d"), "destination"), F.concat(F.lit("v"), F.col("v") % 5)).alias("edges"))
    return ag.edge_frequency(cuts, ["source"], "edges")


@query("select source, round(sum(v * (event_id % 4 + 1)) / sum(event_id % 4 + 1), 6) mean, min(v) min, max(v) max, cast(sum(event_id % 4 + 1) as bigint) count from fw group by 1", FLOWS)
def sensitivity_weighted_mean(spark, sf):
    rows = event_flows(spark, sf).withColumn("times", F.col("event_id") % 4 + 1)
    return ag.weighted_sensitivity(rows, ["source"], "v", "times").withColumn("mean", F.round("mean", 6))


@query("select source, cast(sum(v) as bigint) total_demand, cast(sum(least(v, 40)) as bigint) total_placed, round(sum(least(v, 40)) / sum(v), 9) overall_ratio, count(*) filter (v > 40) dropped_flows, count(*) num_flows from fw group by 1", FLOWS)
def flow_summary(spark, sf):
    f = event_flows(spark, sf).select("source", F.col("v").alias("demand"), F.least(F.col("v"), F.lit(40)).alias("placed"))
    return ag.flow_summary(f, ["source"]).withColumn("overall_ratio", F.round("overall_ratio", 9))


@query("select source, destination as cost, cast(sum(v) as bigint) volume from fw group by 1, 2", FLOWS)
def cost_distribution_merge(spark, sf):
    c = event_flows(spark, sf).select("source", F.col("destination").alias("cost"), F.col("v").alias("volume"))
    return ag.merge_costs(c, ["source"]).select("source", F.explode("cost_distribution").alias("cost", "volume"))


@query("select source, destination as cost, round(avg(v), 6) mean, min(v) min, max(v) max, count(*) total_samples from fw group by 1, 2", FLOWS)
def flow_cost_statistics(spark, sf):
    c = event_flows(spark, sf).select("source", F.col("destination").alias("cost"), F.col("v").alias("volume"))
    return ag.cost_statistics(c, ["source"]).withColumn("mean", F.round("mean", 6))


@query("select distinct cast(v * 0.125 as double) as x, rtrim(rtrim(printf('%.9f', v * 0.125), '0'), '.') as key from fw where v > 0", FLOWS)
def number_keys(spark, sf):
    x = event_flows(spark, sf).filter("v > 0").select((F.col("v") * 0.125).alias("x")).distinct()
    return x.select("x", number_key_column(F.col("x")).alias("key"))


LIBRARY = {"box": {"capex": 100.0, "power_watts": 10.0, "capacity": 3000.0, "ports": 8, "children": {"card": {"capex": 7.0, "power_watts": 1.0, "count": 2}}}, "optic": {"capex": 1.5, "power_watts": 0.5, "capacity": 400.0, "ports": 1}}


def equipped(spark, sf):
    n, k = nation_nodes(spark, sf), nation_links(spark, sf)
    n = n.withColumn("attrs", F.when(F.col("node_ord") % 3 != 2, F.to_json(F.struct(F.struct(F.lit("box").alias("component"), (F.col("node_ord") % 2 + 1).alias("count")).alias("hardware")))).otherwise(F.lit("{}")))
    side = F.struct(F.lit("optic").alias("component"), F.lit(2).alias("count"))
    k = k.withColumn("attrs", F.to_json(F.struct(F.struct(side.alias("source"), side.alias("target")).alias("hardware"))))
    return n, k, hw.library_frame(spark, LIBRARY)


BUY = """buy as (select name, 'box' component, cast(k % 2 + 1 as double) pieces, 114.0 * (k % 2 + 1) capex, 12.0 * (k % 2 + 1) power from nd where not disabled and k % 3 <> 2
 union all select nd.name, 'optic', 2.0, 3.0, 1.0 from lk join nd on nd.name in (source, target) where not lk.disabled and not nd.disabled and nd.k % 3 <> 2),
 pre as (select *, '' path, 0 as level from buy union all select *, split_part(name, '/', 1), 1 from buy union all select *, name, 2 from buy)"""


@query("select level, path, cast(sum(capex) as double) capex, cast(sum(power) as double) power_watts from pre group by 1, 2", ND, LK, BUY)
def cost_power_levels(spark, sf):
    return hw.cost_power(*equipped(spark, sf))


@query("select path, component, sum(pieces) pieces from pre group by 1, 2", ND, LK, BUY)
def bom_by_path(spark, sf):
    n, k, c = equipped(spark, sf)
    return hw.bill_of_materials(n, k, c, include_disabled=False)


@query("""select name, attached, attached / (3000.0 * (k % 2 + 1)) capacity_utilization, attached > 3000.0 * (k % 2 + 1) capacity_violation from nd join
 (select x, sum(capacity) attached from (select source x, capacity from al union all select target, capacity from al) group by x) on x = name where not disabled and k % 3 <> 2""", ND, LK, AL)
def node_utilization(spark, sf):
    return hw.utilization(*equipped(spark, sf)).filter("attached > 0").select("name", "attached", "capacity_utilization", "capacity_violation")


@query("select link_id, capacity link_capacity, cast(800 as double) end_capacity from lk join nd a on a.name = source join nd b on b.name = target where capacity > 800 and (a.k % 3 <> 2 or b.k % 3 <> 2)", ND, LK)
def link_issues(spark, sf):
    n, k, c = equipped(spark, sf)
    return hw.link_issues(k, n, c)


@query("select split_part(name, '/', 1) path, count(*) node_count, count(*) filter (not disabled) active_count from nd group by 1 union all select '', count(*), count(*) filter (not disabled) from nd union all select name, 1, case when disabled then 0 else 1 end from nd", ND)
def node_counts(spark, sf):
    return ag.node_counts(nation_nodes(spark, sf)).select("path", "node_count", "active_count")


@query("""select path, count(*) filter (i) internal_count, coalesce(sum(capacity) filter (i), 0) internal_capacity, count(*) filter (not i) external_count, coalesce(sum(capacity) filter (not i), 0) external_capacity from
 (select '' path, true i, capacity from lk union all select split_part(source, '/', 1), split_part(source, '/', 1) = split_part(target, '/', 1), capacity from lk
  union all select split_part(target, '/', 1), false, capacity from lk where split_part(source, '/', 1) <> split_part(target, '/', 1)
  union all select source, false, capacity from lk union all select target, false, capacity from lk) group by path""", ND, LK)
def explorer_internal_external(spark, sf):
    return ag.link_locality(nation_links(spark, sf))


@query("""select path, far_end, count(*) link_count, sum(capacity) link_capacity from (select source path, target far_end, capacity from lk union all select target, source, capacity from lk
 union all select split_part(source, '/', 1), target, capacity from lk where split_part(source, '/', 1) <> split_part(target, '/', 1) union all select split_part(target, '/', 1), source, capacity from lk where split_part(source, '/', 1) <> split_part(target, '/', 1)) group by 1, 2""", ND, LK)
def explorer_breakdown(spark, sf):
    return ag.external_breakdown(nation_links(spark, sf))


@query("select origin, node, cost from d32", ND, LK, AL, *COSTS)
def shortest_path_costs(spark, sf):
    nodes, links = nation_nodes(spark, sf), nation_links(spark, sf)
    sources = nodes.filter("not disabled").select("name")
    return paths.shortest_costs(topology.active_edges(links, nodes), sources)


@query("""select a.region src_label, b.region dst_label, coalesce(min(cast(d.cost as double)), cast('infinity' as double)) as cost from nd a join nd b on a.region <> b.region left join d32 d on d.origin = a.name and d.node = b.name
  where not a.disabled and not b.disabled group by 1, 2""", ND, LK, AL, *COSTS)
def group_path_costs(spark, sf):
    """The least cost between any two nodes of two regions, by joins alone."""
    nodes, links = nation_nodes(spark, sf), nation_links(spark, sf)
    groups = select_nodes(nodes, "([A-Z ]+)/").select("label", "name")
    costs = paths.shortest_costs(topology.active_edges(links, nodes), groups.select("name"))
    found = paths.group_costs(costs, groups, groups).withColumn("cost", F.col("cost").cast("double"))
    return topology.fill_missing(topology.group_pairs(groups, groups), found, "cost", float("inf"))


@query("""select 'ASIA' src_label, 'EUROPE' dst_label, (select sum(capacity) from al where source like 'ASIA/%' and target like 'EUROPE/%')
 + (select sum(capacity) from al where target like 'ASIA/%' and source like 'EUROPE/%') total_flow""", ND, LK, AL)
def max_flow_direct(spark, sf):
    """Direct links alone between two regions: the flow is their capacity."""
    net = nation_network(spark, sf)
    links = find_links(net.links, "^ASIA/", "^EUROPE/", True)
    from dataclasses import replace

    return Analysis(replace(net, links=links)).max_flow("(ASIA)/", "(EUROPE)/").select("src_label", "dst_label", "total_flow")


# Beyond SQL: kernels -----------------------------------------------------------------------------

SHIP = [{"id": "ae", "source": "ASIA/.*", "target": "EUROPE/.*", "volume": 500.0, "mode": "pairwise", "flow_policy": "SHORTEST_PATHS_WCMP"}, {"id": "aa", "source": "AMERICA/.*", "target": "AFRICA/.*", "volume": 300.0, "priority": 1, "flow_policy": "TE_WCMP_UNLIM"}]
POLICY = {"modes": [{"weight": 1.0, "rules": [{"scope": "node", "mode": "choice", "count": 1}]}, {"weight": 2.0, "rules": [{"scope": "link", "mode": "choice", "count": 2}]}]}


@query()
def max_flow_pairwise(spark, sf):
    return Analysis(nation_network(spark, sf)).max_flow("([A-Z ]+)/", "([A-Z ]+)/", "pairwise").select("src_label", "dst_label", "total_flow", F.explode_outer("cost_distribution").alias("cost", "volume"))


@query()
def sensitivity_combine(spark, sf):
    return Analysis(nation_network(spark, sf)).sensitivity("ASIA/.*", "EUROPE/.*", shortest_path=True)


@query()
def k_shortest(spark, sf):
    r = Analysis(nation_network(spark, sf)).k_shortest_paths("(ASIA/NATION_1.*)", "(EUROPE/.*)", 3)
    return r.select("src_label", "dst_label", "cost", F.array_join(F.transform("hops", lambda h: h["node"]), " > ").alias("path"))


@query()
def traffic_placement(spark, sf):
    return Analysis(nation_network(spark, sf)).place(SHIP).select("demand_id", "src", "dst", "demand", "placed")


@query()
def maximum_supported_demand(spark, sf):
    a = Analysis(nation_network(spark, sf)).maximum_supported_demand(SHIP[:1], resolution=0.5)
    return spark.createDataFrame([(a,)], "alpha double")


@query()
def monte_carlo_max_flow(spark, sf):
    a = Analysis(nation_network(spark, sf))
    f = a.max_flow("ASIA/.*", "EUROPE/.*", patterns=a.monte_carlo(POLICY, 200, 7))
    return ag.envelope(ag.frequencies(f, ["src_label", "dst_label"], "total_flow", "occurrence_count"), ["src_label", "dst_label"])


ENDS = "ends as (select arg_min(name, k) o, arg_max(name, k) t from nd where not disabled)"
DAG = """dag as (select e.src, e.dst, e.link_id, cast(1.0 as double) / count(*) over (partition by e.src) part from e, ends, d32 a, d32 b, d32 c
  where a.origin = o and a.node = e.src and b.origin = e.dst and b.node = t and c.origin = o and c.node = t and a.cost + e.w + b.cost = c.cost)"""


@query("""select src, dst, link_id, round(sum(share), 9) as share from (with recursive r(src, dst, link_id, share) as (
  select src, dst, link_id, part from dag, ends where src = o union all select dag.src, dag.dst, dag.link_id, r.share * part from r join dag on dag.src = r.dst) select * from r) group by 1, 2, 3""", ND, LK, AL, *COSTS, ENDS, DAG)
def equal_split_shares(spark, sf):
    nodes, links = nation_nodes(spark, sf), nation_links(spark, sf)
    ends = nodes.filter("not disabled").agg(F.min_by("name", "node_ord").alias("a"), F.max_by("name", "node_ord").alias("b")).first()
    return paths.equal_split(topology.active_edges(links, nodes), ends.a, ends.b).withColumn("share", F.round("share", 9))


@query("select link_id from lk where source = (select min(name) from nd) and target = (select max(name) from nd)", ND, LK)
def links_between_ends(spark, sf):
    n = nation_nodes(spark, sf).agg(F.min("name").alias("a"), F.max("name").alias("b")).first()
    return links_between(nation_links(spark, sf), n.a, n.b).select("link_id")
