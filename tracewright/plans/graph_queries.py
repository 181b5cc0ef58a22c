"""Queries over graphs: paths, closures, roots, layers, hubs, centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import graph, rules
from tracewright.plans import dag
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register

# A directed graph without cycles over customers: i -> 2 i + 1 and i -> 3 i + 2, cut into trees by residue.
FLOW = "flow AS (SELECT c_custkey AS u, 2 * c_custkey + 1 AS v FROM customer WHERE c_custkey % 3 <> 0 AND 2 * c_custkey + 1 < (SELECT count(*) FROM customer) UNION SELECT c_custkey, 3 * c_custkey + 2 FROM customer WHERE c_custkey % 4 = 0 AND 3 * c_custkey + 2 < (SELECT count(*) FROM customer))"


def flow(spark, d):
    c = table(spark, d, "customer")
    n, k = c.count(), F.col("c_custkey")
    one = c.where(k % 3 != 0).select(k.alias("u"), (2 * k + 1).alias("v"))
    two = c.where(k % 4 == 0).select(k.alias("u"), (3 * k + 2).alias("v"))
    return one.unionByName(two).where(F.col("v") < n).distinct()


def starts(spark, d, condition):
    return table(spark, d, "customer").where(condition).select(F.col("c_custkey").alias("node"))


@register("shortest_hops", f"WITH RECURSIVE {FLOW}, e AS (SELECT u, v FROM flow UNION SELECT v, u FROM flow), walk AS (SELECT 5 AS start, CAST(5 AS BIGINT) AS node, 0 AS hops UNION SELECT start, e.v, hops + 1 FROM walk JOIN e ON walk.node = e.u WHERE hops < 12) SELECT node, min(hops) AS hops FROM walk GROUP BY node")
def shortest_hops(spark, d):
    return graph.hops(flow(spark, d), starts(spark, d, "c_custkey = 5"), most=12).select("node", "hops")


@register("ego_radius", f"WITH RECURSIVE {FLOW}, e AS (SELECT u, v FROM flow UNION SELECT v, u FROM flow), s AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 25 = 4), walk AS (SELECT node AS start, node, 0 AS hops FROM s UNION SELECT start, e.v, hops + 1 FROM walk JOIN e ON walk.node = e.u WHERE hops < 2) SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL")
def ego_radius(spark, d):
    return graph.ego(flow(spark, d), starts(spark, d, "c_custkey % 25 = 4"), 2)


@register("impact_closure", f"WITH RECURSIVE {FLOW}, walk AS (SELECT c_custkey AS node FROM customer WHERE c_custkey IN (1, 4, 10) UNION SELECT flow.v FROM walk JOIN flow ON walk.node = flow.u) SELECT node FROM walk")
def impact_closure(spark, d):
    return graph.closure(flow(spark, d), starts(spark, d, "c_custkey in (1, 4, 10)"))


@register("rail_roots", f"WITH {FLOW} SELECT DISTINCT u AS node FROM flow WHERE u NOT IN (SELECT v FROM flow)")
def rail_roots(spark, d):
    return graph.roots(flow(spark, d))


@register("topological_levels", f"WITH RECURSIVE {FLOW}, walk AS (SELECT DISTINCT u AS node, 0 AS level FROM flow WHERE u NOT IN (SELECT v FROM flow) UNION SELECT flow.v, level + 1 FROM walk JOIN flow ON walk.node = flow.u) SELECT node, max(level) AS level FROM walk GROUP BY node")
def topological_levels(spark, d):
    return graph.levels(flow(spark, d))


@register("dependency_cycles", "WITH RECURSIVE e AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS u, CAST((s_nationkey * 3 + s_suppkey % 2) % 25 AS BIGINT) AS v FROM supplier), p AS (SELECT [u] AS nodes, v AS cur FROM e WHERE v >= u UNION ALL SELECT list_append(nodes, cur), e.v FROM p JOIN e ON p.cur = e.u WHERE cur > nodes[1] AND NOT list_contains(nodes, cur)) SELECT DISTINCT array_to_string(nodes, '>') AS cycle FROM p WHERE cur = nodes[1]")
def dependency_cycles(spark, d):
    """Cycles of any length over all nations."""
    n = F.col("s_nationkey").cast("bigint")
    edges = table(spark, d, "supplier").select(n.alias("u"), ((n * 3 + F.col("s_suppkey") % 2) % 25).alias("v"))
    return graph.cycles(edges).select(F.array_join("nodes", ">").alias("cycle"))


PINS = "SELECT component_id AS u, net_id AS v FROM pin_edges"


def pin_graph(spark, d):
    return table(spark, d, "pin_edges").select(F.col("component_id").alias("u"), F.col("net_id").alias("v"))


@register("high_degree_hubs", sql("pin_edges", "SELECT net_id AS node, count(DISTINCT component_id) AS degree FROM pin_edges GROUP BY 1 HAVING count(DISTINCT component_id) >= 8 UNION ALL SELECT component_id, count(DISTINCT net_id) FROM pin_edges GROUP BY 1 HAVING count(DISTINCT net_id) >= 8"))
def high_degree_hubs(spark, d):
    return graph.hubs(pin_graph(spark, d), 8)


@register("erc_dangling_nets", sql("few_pins", "SELECT net_id FROM few_pins GROUP BY 1 HAVING count(DISTINCT component_id) < 2"))
def erc_dangling_nets(spark, d):
    return rules.dangling_nets(table(spark, d, "few_pins")).select(F.col("object_ids")[0].alias("net_id"))


@register("erc_unused_components", sql("pin_edges", "SELECT concat('K', CAST(o_orderkey AS STRING)) AS id FROM orders WHERE concat('K', CAST(o_orderkey AS STRING)) NOT IN (SELECT component_id FROM pin_edges)"))
def erc_unused_components(spark, d):
    components = table(spark, d, "orders").select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("id"))
    return rules.unused_components(components, table(spark, d, "pin_edges")).select(F.col("object_ids")[0].alias("id"))


@register("topology_metrics", f"WITH RECURSIVE {FLOW}, e AS (SELECT u, v FROM flow UNION SELECT v, u FROM flow), n AS (SELECT DISTINCT u AS node FROM e), reach AS (SELECT node, node AS other FROM n UNION SELECT r.node, e.v FROM reach r JOIN e ON r.other = e.u), l AS (SELECT node, min(other) AS c FROM reach GROUP BY 1) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM flow) AS edges, (SELECT count(DISTINCT c) FROM l) AS components, round(2e0 * (SELECT count(*) FROM flow) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 8) AS density")
def topology_metrics(spark, d):
    edges = flow(spark, d)
    return graph.metrics(graph.both_ways(edges).select(F.col("u").alias("node")), edges)


@register("simple_paths", f"WITH RECURSIVE {FLOW}, e AS (SELECT u, v FROM flow UNION SELECT v, u FROM flow), p AS (SELECT [CAST(4 AS BIGINT)] AS nodes UNION ALL SELECT list_append(nodes, e.v) FROM p JOIN e ON p.nodes[-1] = e.u WHERE NOT list_contains(nodes, e.v) AND len(nodes) < 7 AND p.nodes[-1] <> 29) SELECT array_to_string(nodes, '>') AS path, len(nodes) - 1 AS hops FROM p WHERE nodes[-1] = 29 AND len(nodes) > 1 ORDER BY len(nodes), nodes LIMIT 100")
def simple_paths(spark, d):
    out = graph.simple_paths(flow(spark, d), 4, 29, cutoff=6)
    return out.select(F.array_join("nodes", ">").alias("path"), F.col("hops").cast("bigint").alias("hops"))


@register("neighbourhood_hashes", sql("pin_edges", """
e AS (SELECT component_id AS u, net_id AS v FROM pin_edges UNION ALL SELECT net_id, component_id FROM pin_edges), h0 AS (SELECT DISTINCT u AS node, sha256(CASE WHEN starts_with(u, 'K') THEN 'component' ELSE 'net' END) AS hash FROM e),
h1 AS (SELECT h0.node, sha256(concat(any_value(h0.hash), '|', string_agg(o.hash, ',' ORDER BY o.hash))) AS hash FROM h0 JOIN e ON e.u = h0.node JOIN h0 o ON o.node = e.v GROUP BY 1),
h2 AS (SELECT h1.node, sha256(concat(any_value(h1.hash), '|', string_agg(o.hash, ',' ORDER BY o.hash))) AS hash FROM h1 JOIN e ON e.u = h1.node JOIN h1 o ON o.node = e.v GROUP BY 1)
SELECT hash, count(*) AS n FROM h2 GROUP BY 1"""))
def neighbourhood_hashes(spark, d):
    """Two rounds, so that neighbours of neighbours count."""
    edges = pin_graph(spark, d)
    nodes = edges.select(F.col("u").alias("node"), F.lit("component").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.lit("net").alias("label"))).distinct()
    return graph.neighbourhood_hash(nodes, edges, 2).groupBy("hash").agg(F.count("*").alias("n"))


@register("betweenness")
def betweenness(spark, d):
    edges = flow(spark, d)
    return graph.betweenness(edges, edges.select(F.explode(F.array("u", "v"))).distinct().count())


@register("articulation_nodes")
def articulation_nodes(spark, d):
    return graph.articulation_nodes(flow(spark, d))


@register("bridge_edges")
def bridge_edges(spark, d):
    return graph.bridges(flow(spark, d))


@register("layered_layout", f"WITH RECURSIVE {FLOW}, e AS (SELECT u, v FROM flow UNION SELECT v, u FROM flow), n AS (SELECT DISTINCT u AS node FROM e), reach AS (SELECT node, node AS other FROM n UNION SELECT r.node, e.v FROM reach r JOIN e ON r.other = e.u), l AS (SELECT node, min(other) AS c FROM reach GROUP BY 1), walk AS (SELECT DISTINCT c AS start, c AS node, 0 AS hops FROM l UNION SELECT start, e.v, hops + 1 FROM walk JOIN e ON walk.node = e.u WHERE hops < 40), h AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL) SELECT node, hops * 40e0 AS x, (row_number() OVER (PARTITION BY start, hops ORDER BY node) - 1) * 20e0 AS y FROM h")
def layered_layout(spark, d):
    return graph.layered_layout(flow(spark, d)).select("node", "x", "y")


@register("pipeline_order", "WITH n AS (SELECT n_nationkey AS k FROM nation), p AS (SELECT k, concat('step', lpad(CAST(k AS STRING), 2, '0')) AS node FROM n) SELECT row_number() OVER (ORDER BY k DESC) - 1 AS place, node FROM p")
def pipeline_order(spark, d):
    """Steps that each need the step after them by number: they run from the last to the first."""
    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    name = lambda i: f"step{i:02}"
    g = dag.Dag([dag.Node(name(i), (name(i + 1),) if i + 1 in keys else (), (name(i),)) for i in keys])
    return spark.createDataFrame(list(enumerate(g.order())), "place long, node string")
