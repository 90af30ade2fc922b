"""Registered queries over whole tables, against brute force on small ones."""

from itertools import accumulate

from pyspark.sql import functions as F

from latticeflow import queries


def test_shared_risk_reads_all_orders(spark, tmp_path):
    # c1 - g2 - c2 - g3 - c3 hang together; c8 and c9 share a group of their own.
    orders = [(2, 1), (999, 2), (3, 2), (1000, 3), (4, 9), (1001, 8), (35, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    held = [(f"c{c}", o % 997) for o, c in orders]
    found = {min(e for e, _ in held)}
    while more := {e for e, g in held if g in {h for x, h in held if x in found}} - found:
        found |= more
    got = [r.entity for r in queries.Q["shared_risk"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(found) == ["c1", "c2", "c3"]


def test_descendants_reach_all_of_part(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = [r.group for r in queries.Q["rg_descendants"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"g{k}" for k in range(2000))


def test_cumulative_weights_run_over_all_of_part(spark, tmp_path):
    sizes = {k: (k * 37) % 50 + 1 for k in range(1000)}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = queries.Q["mode_pick_cumulative"](spark, str(tmp_path))
    got = {r.p_partkey: r.upto for r in df.collect()}
    assert got == dict(zip(sizes, accumulate(max(0, s - 10) for s in sizes.values()), strict=True))


def test_shortest_costs_of_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    nodes = [r.name for r in queries.nation_nodes(spark, sf).filter("not disabled").collect()]
    cost = {(a, b): 0 if a == b else 10**6 for a in nodes for b in nodes}
    for r in queries.nation_links(spark, sf).filter("not disabled").collect():
        if r.source in nodes and r.target in nodes:
            for e in ((r.source, r.target), (r.target, r.source)):
                cost[e] = min(cost[e], int(r.cost))
    for k in nodes:
        for a in nodes:
            for b in nodes:
                cost[a, b] = min(cost[a, b], cost[a, k] + cost[k, b])
    got = {(r.origin, r.node): r.cost for r in queries.Q["shortest_path_costs"](spark, sf).collect()}
    assert got == {e: c for e, c in cost.items() if c < 10**6}
    assert len({a for a, _ in got}) == len(nodes)
