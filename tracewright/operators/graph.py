"""Graphs as edge tables: components, paths, closures, cycles, layers, neighbourhood hashes, centrality."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.storage import cut, drop


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rows: int | None = None, at_once: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node reachable.

    First every node gives way to the least of itself and its neighbours, again and again while that halves the
    edges: what hangs on one node is then one node, and is named again at the end. Then large-star and
    small-star in turn (Kiveris et al., 2014): the number of rounds grows with the
    logarithm of the longest path. Each round is cut to the shared folder, in files sized by the number of
    edges before it (rows for the first, if known), and the table before it deleted; the driver sees only a
    count and a checksum of the edges. A graph of at_once edges or fewer, counted, is solved in one task.
    """
    few = 2_000_000  # edges in a file
    e = cut(edges.select("u", "v").where("u <> v").distinct(), "edges", "lz4", free=False, rows=rows, per_file=few)
    e, leads = _contracted(e, at_once, few)
    label = _labels(e, at_once, few)
    for lead in reversed(leads):
        up = label.select(F.col("node").alias("lead"), "component").hint("merge")
        label = lead.join(up, "lead", "left").select("node", F.coalesce("component", "lead").alias("component"))
    return label


def _contracted(e: DataFrame, at_once: int, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """The edges between classes of nodes, each named by its least lead, and tables (node, lead) by round.

    A class is the nodes of one lead, which is one of them or next to all of them, so classes are linked as their nodes
    are; the least node of a component leads itself, so the least class of a component bears its name.
    """
    leads, n = [], e.count()
    while n > at_once:
        least = both_ways(e).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("lead"))
        lead = cut(least, "leads", "lz4", free=False, rows=2 * n, per_file=few)
        ends = [lead.select(F.col("node").alias(c), F.col("lead").alias(f"{c}_lead")).hint("merge") for c in "uv"]
        between = e.join(ends[0], "u").join(ends[1], "v").where("u_lead <> v_lead")
        between = between.select(F.least("u_lead", "v_lead").alias("u"), F.greatest("u_lead", "v_lead").alias("v")).distinct()
        e, before = cut(between, "edges", "lz4", free=False, rows=n, per_file=few), e
        drop(before)
        leads.append(lead)
        n, last = e.count(), n
        if 2 * n > last:
            break
    return e, leads


def _labels(e: DataFrame, at_once: int, few: int) -> DataFrame:
    """components() of cut edges, by stars or in one task."""
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        if seen is None and state[0] <= at_once:
            return _solve(e)
        seen = state
        both = both_ways(e)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e, before = cut(small.where("u <> v").distinct(), "edges", "lz4", free=False, rows=2 * state[0], per_file=few), e
        drop(before)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _solve(e: DataFrame) -> DataFrame:
    """components() of a small table of edges, in one task."""
    kind = e.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        ends = pc.index_in(both, names).to_numpy()
        i, j = ends[: table.num_rows], ends[table.num_rows :]
        label = np.arange(len(names))
        while True:  # the least label of both ends, then of what that label leads to
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, before[i], low)
            np.minimum.at(label, before[j], low)
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["node", "component"])

    return e.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """components() for all nodes (column node), those without an edge being their own."""
    return nodes.select("node").distinct().join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """(start, node, hops): the fewest edges from each start (column node), by a frontier that grows a step a round.

    A round writes its own level only. Without directions a step leads one level up or down or stays, so what it
    finds need be compared with the last two levels only; with directions, with all.
    """
    steps = edges.select("u", "v").distinct() if directed else both_ways(edges).distinct()
    steps = cut(steps, "steps", "lz4", free=False)
    levels_ = [cut(starts.select(F.col("node").alias("start"), "node").distinct(), "hops", "lz4", free=False)]
    while most is None or len(levels_) <= most:
        reached = levels_[-1].join(steps, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct()
        for before in levels_ if directed else levels_[-2:]:
            reached = reached.join(before, ["start", "node"], "left_anti")
        fresh = cut(reached, "hops", "lz4", free=False)
        if fresh.isEmpty():
            break
        levels_.append(fresh)
    return reduce(DataFrame.unionByName, [level.withColumn("hops", F.lit(k)) for k, level in enumerate(levels_)])


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The starts and all that lies downstream of them (column node)."""
    return hops(edges, starts, directed=True).select("node").distinct()


def simple_paths(edges: DataFrame, start, end, cutoff: int = 12, most: int = 100) -> DataFrame:
    """(nodes, hops) of paths without repeats, shortest first, then in order of nodes; most of them at most (a top-k report)."""
    steps = cut(both_ways(edges).distinct(), "steps", "lz4", free=False)
    spark = edges.sparkSession
    kind = steps.schema["u"].dataType
    paths = spark.createDataFrame([([start],)], f"nodes array<{kind.simpleString()}>")
    found = paths.where(F.lit(False))
    for _ in range(cutoff):
        longer = paths.withColumn("u", F.element_at("nodes", -1)).join(steps, "u").where(~F.array_contains("nodes", F.col("v"))).select(F.array_append("nodes", F.col("v")).alias("nodes"))
        longer = cut(longer, "paths", "lz4", free=False)
        if longer.isEmpty():
            break
        found = found.unionByName(longer.where(F.element_at("nodes", -1) == F.lit(end)))
        paths = longer.where(F.element_at("nodes", -1) != F.lit(end))
    return found.withColumn("hops", F.size("nodes") - 1).orderBy("hops", "nodes").limit(most)


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are upstream of something and downstream of nothing."""
    return edges.select(F.col("u").alias("node")).distinct().join(edges.select(F.col("v").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")


def levels(edges: DataFrame, strict: bool = True) -> DataFrame:
    """(node, level): 0 for roots, else one more than the deepest predecessor.

    Nodes on or behind a cycle have no level: strict refuses such a graph, otherwise they are left out. A
    round writes one table, of the nodes with the number of their predecessors that have no level yet.
    """
    steps = cut(edges.select("u", "v").distinct(), "steps", "lz4", free=False)
    missing = steps.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("missing"))
    nodes = both_ways(steps).select(F.col("u").alias("node")).distinct()
    state = nodes.join(missing, "node", "left").select("node", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.col("missing").isNull(), 0).alias("level"))
    state, level = cut(state, "levels", "lz4", free=False), 0
    n, ready = state.agg(F.count("*"), F.count(F.when(F.col("level") == 0, 1))).first()
    done = ready
    while ready:
        met = state.where(F.col("level") == level).join(steps, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.count("*").alias("met"))
        left = F.col("missing") - F.coalesce("met", F.lit(0))
        level += 1
        fresh = F.when(F.col("level").isNull() & (left == 0), level)
        after = state.join(met, "node", "left").select("node", left.alias("missing"), F.coalesce("level", fresh).alias("level"))
        state, before = cut(after, "levels", "lz4", free=False, rows=n, per_file=2_000_000), state
        drop(before)
        ready = state.where(F.col("level") == level).count()
        done += ready
    if strict and done < n:
        raise ValueError(f"{n - done} nodes lie on or behind a cycle")
    return state.where("level is not null").select("node", "level")


def has_cycle(edges: DataFrame) -> bool:
    return _cyclic(edges).count() > 0


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(nodes) of every simple directed cycle, of at most longest nodes if given, beginning at its least node.

    Only edges between nodes that reach each other are walked: all others lie on no cycle.
    """
    steps = cut(_cyclic(edges), "steps", "lz4", free=False)
    paths = steps.where("v >= u").select(F.array("u").alias("nodes"), F.col("v").alias("to"))
    found, length = None, 0
    while longest is None or length < longest:
        closed = paths.where(F.col("to") == F.element_at("nodes", 1)).select("nodes")
        found = closed if found is None else found.unionByName(closed)
        open_ = paths.where((F.col("to") > F.element_at("nodes", 1)) & ~F.array_contains("nodes", F.col("to")))
        paths = cut(open_.select(F.array_append("nodes", F.col("to")).alias("nodes"), F.col("to").alias("u")).join(steps, "u").select("nodes", F.col("v").alias("to")), "cycles", "lz4", free=False)
        length += 1
        if paths.isEmpty():
            break
    return found.distinct() if found is not None else steps.select(F.array("u").alias("nodes")).limit(0)


def _cyclic(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without a way in or without a way out are taken away, again and again."""
    left = cut(edges.select("u", "v").distinct(), "cyclic", "lz4", free=False)
    n = left.count()
    while n:
        ins, outs = left.select(F.col("v").alias("u")).distinct(), left.select(F.col("u").alias("v")).distinct()
        kept = cut(left.join(ins, "u", "left_semi").join(outs, "v", "left_semi").select("u", "v"), "cyclic", "lz4", free=False, rows=n, per_file=2_000_000)
        drop(left)
        left, before, n = kept, n, kept.count()
        if n == before:
            break
    return left


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours of each node of an undirected graph."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()  # each once, not in both directions
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, least: int = 4) -> DataFrame:
    return degrees(edges).where(F.col("degree") >= least)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, density, of an undirected simple graph."""
    n = nodes.select("node").distinct().agg(F.count("*").alias("nodes"))
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().agg(F.count("*").alias("edges"))
    parts = label_components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    return n.join(pairs).join(parts).withColumn("density", F.when(F.col("nodes") > 1, F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 8)).otherwise(0.0))


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of every island, in any order."""
    return label_components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))


def ego(edges: DataFrame, starts: DataFrame, radius: int = 2) -> DataFrame:
    """(start, node, hops) within the radius of each start."""
    return hops(edges, starts, most=radius)


def neighbourhood_hash(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, hash) after Weisfeiler-Lehman rounds over (node, label): equal hashes for alike neighbourhoods."""
    labels = cut(nodes.select("node", F.sha2(F.col("label").cast("string"), 256).alias("hash")), "labels", "lz4", free=False)
    steps = cut(both_ways(edges).where("u <> v").distinct(), "steps", "lz4", free=False)
    # bytes sort as their hexadecimal digits do; alike neighbours of a node are counted before they are brought together
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.array_repeat(F.lower(F.hex(x["code"])), x["n"].cast("int"))))
    for _ in range(rounds):
        met = steps.join(labels.select(F.col("node").alias("v"), F.unhex("hash").alias("code")), "v").groupBy("u", "code").agg(F.count("*").alias("n"))
        around = met.groupBy(F.col("u").alias("node")).agg(F.array_join(repeated, ",").alias("around"))
        labels = cut(labels.join(around, "node", "left").select("node", F.sha2(F.concat_ws("|", F.col("hash"), F.coalesce("around", F.lit(""))), 256).alias("hash")), "labels", "lz4", free=False)
    return labels


def _adjacency(part: pd.DataFrame) -> dict:
    near: dict = {}
    for u, v in zip(part["u"], part["v"], strict=True):
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    return {k: sorted(v) for k, v in sorted(near.items())}


def _shortest_path_shares(near: dict, sources: list) -> dict:
    """What the sources add to unnormalised betweenness, by a breadth-first search from each and a sum back up (Brandes, 2001)."""
    share = dict.fromkeys(near, 0.0)
    for source in sources:
        depth, ways, order, before = {source: 0}, {source: 1.0}, [], {source: []}
        queue = deque([source])
        while queue:
            at = queue.popleft()
            order.append(at)
            for to in near[at]:
                if to not in depth:
                    depth[to], ways[to], before[to] = depth[at] + 1, 0.0, []
                    queue.append(to)
                if depth[to] == depth[at] + 1:
                    ways[to] += ways[at]
                    before[to].append(at)
        due = dict.fromkeys(order, 0.0)
        for node in reversed(order):
            for prior in before[node]:
                due[prior] += ways[prior] / ways[node] * (1 + due[node])
            if node != source:
                share[node] += due[node]
    return {k: v / 2 for k, v in share.items()}


def _cut_points(near: dict) -> tuple[set, set]:
    """Articulation nodes and bridges by depth-first discovery times, without recursion."""
    found, low, nodes, links = {}, {}, set(), set()
    for root in near:
        if root in found:
            continue
        found[root] = low[root] = len(found)
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            at, parent, rest = stack[-1]
            for to in rest:
                if to == parent:
                    continue
                if to in found:
                    low[at] = min(low[at], found[to])
                else:
                    found[to] = low[to] = len(found)
                    stack.append((to, at, iter(near[to])))
                    break
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[at])
                if low[at] > found[parent]:
                    links.add((min(at, parent), max(at, parent)))
                if parent == root:
                    children += 1
                elif low[at] >= found[parent]:
                    nodes.add(parent)
        if children > 1:
            nodes.add(root)
    return nodes, links


def _by_component(edges: DataFrame) -> DataFrame:
    label = components(edges)
    return edges.select("u", "v").where("u <> v").join(label, edges["u"] == label["node"]).select("component", "u", "v")


def betweenness(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(node, betweenness), normalised by the pairs of n_nodes nodes.

    A search from each node makes the work the product of a component's nodes and edges, so a task has the
    edges of one component and the searches from about 64 of its nodes.
    """
    kind = edges.schema["u"].dataType.simpleString()
    scale = 1.0 if n_nodes <= 2 else 2.0 / ((n_nodes - 1) * (n_nodes - 2))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near, tasks, task = _adjacency(part), int(part["tasks"].iloc[0]), int(part["task"].iloc[0])
        share = _shortest_path_shares(near, list(near)[task::tasks])
        return pd.DataFrame({"node": list(share), "share": list(share.values())})

    of = _by_component(edges)
    # a component has at most one node more than edges
    sizes = of.groupBy("component").agg(F.expr("cast(count(*) div 64 + 1 as int)").alias("tasks"))
    dealt = of.join(sizes, "component").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    shares = dealt.groupBy("component", "task").applyInPandas(run, f"node {kind}, share double")
    return shares.groupBy("node").agg(F.round(F.sum("share") * scale, 8).alias("betweenness"))


def articulation_nodes(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()
    return _by_component(edges).groupBy("component").applyInPandas(lambda part: pd.DataFrame({"node": sorted(_cut_points(_adjacency(part))[0])}), f"node {kind}")


def bridges(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()
    return _by_component(edges).groupBy("component").applyInPandas(lambda part: pd.DataFrame(sorted(_cut_points(_adjacency(part))[1]), columns=["u", "v"]), f"u {kind}, v {kind}")


def layered_layout(edges: DataFrame, dx: float = 40.0, dy: float = 20.0) -> DataFrame:
    """(node, x, y): one column for each distance from the least node of a component, nodes in order of name."""
    from pyspark.sql import Window

    label = components(edges)
    start = label.where("node = component")
    far = hops(edges, start.select("node"))
    order = Window.partitionBy("start", "hops").orderBy("node")
    return far.select("node", (F.col("hops") * dx).alias("x"), ((F.row_number().over(order) - 1) * dy).alias("y"))


def manhattan_routes(wires: DataFrame) -> DataFrame:
    """(net_id, k, x1, y1, x2, y2): each wire (net_id, x0, y0, x1, y1) as one or two segments, the horizontal one first."""
    leg = lambda k, a, b, c, d: F.struct(F.lit(k).alias("k"), F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))
    straight = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    legs = F.when(straight, F.array(leg(0, "x0", "y0", "x1", "y1"))).otherwise(F.array(leg(0, "x0", "y0", "x1", "y0"), leg(1, "x1", "y0", "x1", "y1")))
    return wires.select("net_id", F.explode(legs).alias("leg")).select("net_id", "leg.*")


def _wire_sides(segments: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Vertical segments (columns vx, lo, hi) and horizontal ones (hy, left, right), each once for each cell it passes."""
    up = F.col("x1") == F.col("x2")
    at = lambda c: F.floor(c / cell)
    rest = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    v = segments.where(up).select(*[F.col(c).alias(f"v_{c}") for c in rest], F.col("x1").alias("vx"), F.least("y1", "y2").alias("lo"), F.greatest("y1", "y2").alias("hi"))
    h = segments.where(~up & (F.col("y1") == F.col("y2"))).select(*[F.col(c).alias(f"h_{c}") for c in rest], F.col("y1").alias("hy"), F.least("x1", "x2").alias("left"), F.greatest("x1", "x2").alias("right"))
    v = v.withColumn("cx", at(F.col("vx"))).withColumn("cy", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    return v, h.withColumn("cy", at(F.col("hy"))).withColumn("cx", F.explode(F.sequence(at(F.col("left")), at(F.col("right")))))


CROSS = "lo < hy and hy < hi and left < vx and vx < right"


def wire_crossings(segments: DataFrame, cell: float = 8.0) -> DataFrame:
    """(u, v, x, y): vertical and horizontal segments (net_id, x1, y1, x2, y2) of different routes that properly cross.

    A range join on grid cells: each crossing lies in one cell, so none is found twice.
    """
    v, h = _wire_sides(segments.select("net_id", "x1", "y1", "x2", "y2"), cell)
    hit = v.join(h, ["cx", "cy"]).where(F.expr(CROSS) & (F.col("v_net_id") != F.col("h_net_id")))
    return hit.select(F.least("v_net_id", "h_net_id").alias("u"), F.greatest("v_net_id", "h_net_id").alias("v"), F.col("vx").alias("x"), F.col("hy").alias("y"))


def crossing_places(segments: DataFrame, cell: float = 8.0) -> DataFrame:
    """(x, y, n): the places of wire_crossings() and how many there are at each, without the pairs of copies.

    Segments of one place are a class; classes cross as often as the product of their sizes says, less the pairs of one route.
    A null net_id crosses nothing, as in wire_crossings().
    """
    own = segments.where("net_id is not null").select("net_id", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    v, h = _wire_sides(own.groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n")), cell)
    hit = v.join(h, ["cx", "cy"]).where(CROSS).select("vx", "hy", (F.col("v_n") * F.col("h_n")).alias("n"))
    up = F.col("x1") == F.col("x2")
    v = own.where(up).select("net_id", F.col("x1").alias("vx"), F.col("y1").alias("lo"), F.col("y2").alias("hi"))
    h = own.where(~up & (F.col("y1") == F.col("y2"))).select("net_id", F.col("y1").alias("hy"), F.col("x1").alias("left"), F.col("x2").alias("right"))
    same = v.join(h, "net_id").where(CROSS).select("vx", "hy", F.lit(-1).cast("bigint").alias("n"))
    return hit.unionByName(same).groupBy(F.col("vx").alias("x"), F.col("hy").alias("y")).agg(F.sum("n").alias("n")).where("n > 0")
