"""Graphs of facts: call resolution, traversals, paths, cycles, common ancestors and closure.

Every traversal is a loop over a frontier: one join with the edges, an anti join with what was visited, a reliable checkpoint
that cuts the lineage, and a stop as soon as the frontier is empty. A frontier is broadcast only while its counted rows are few.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.schema import EDGE_WEIGHTS, OTHER_WEIGHT
from factweave.session import checkpoint, ship

#: A checkpointed frontier of at most this many rows is broadcast.
FRONTIER_ROWS = 100_000


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FRONTIER_ROWS else df


def nodes_frame(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def raw_calls(facts: DataFrame) -> DataFrame:
    return facts.where("p = 'calls'").select(F.col("s").alias("src"), F.col("o").alias("dst"))


def resolve_calls(facts: DataFrame) -> DataFrame:
    """edges(src, dst), each once: the calls with every callee resolved to a defined symbol where one fits.

    In this order: the id itself; a symbol of that short name whose id contains the package before the dot; one in the
    caller's directory; any of that name (of several the smallest id); else the name as it stands. Candidates are reduced to one
    per (name, package), (name, directory) and name before they meet the calls, so a common name multiplies rows at most by the
    distinct packages it is called with.
    """
    calls = raw_calls(facts).distinct()
    symbols = facts.where("p = 'defines'").select(F.col("o").alias("sym")).distinct()
    named = symbols.select("sym", X.short_name("sym").alias("short"), X.dir_name(X.symbol_file("sym")).alias("dir"))
    calls = calls.join(symbols.select(F.col("sym").alias("dst"), F.lit(True).alias("exact")), "dst", "left")
    open_calls = calls.where("exact is null").select("src", "dst", X.dir_name(X.symbol_file("src")).alias("dir"), F.substring_index(F.substring_index("dst", "/", -1), ".", -1).alias("short"), F.when(F.instr("dst", ".") > 0, F.substring_index("dst", ".", 1)).alias("pkg"))
    wanted = open_calls.where("pkg is not null").select("short", "pkg").distinct()
    by_package = wanted.join(named, "short").where(F.col("sym").contains(F.col("pkg"))).groupBy("short", "pkg").agg(F.min("sym").alias("of_package"))
    by_dir = named.groupBy("short", "dir").agg(F.min("sym").alias("of_dir"))
    by_name = named.groupBy("short").agg(F.min("sym").alias("of_name"))
    found = open_calls.join(by_package, ["short", "pkg"], "left").join(by_dir, ["short", "dir"], "left").join(by_name, "short", "left").select("src", F.coalesce("of_package", "of_dir", "of_name", "dst").alias("dst"))
    return calls.where("exact").select("src", "dst").unionByName(found).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def traverse(edges: DataFrame, start: DataFrame, depth: int, until: str | None = None) -> DataFrame:
    """node, depth: what can be reached from the start nodes in at most ``depth`` steps, by least depth (start: 0)."""
    # More than two rounds read the edges again and again: their derivation is cut off once.
    edges = checkpoint(edges.select("src", "dst")) if depth > 2 else edges.select("src", "dst")
    frontier = checkpoint(start.select("node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for d in range(1, depth + 1):
        rows = frontier.count()
        if rows == 0:
            break
        step = edges.join(_hint(frontier.select(F.col("node").alias("src")), rows), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
        if d % 8 == 0:
            # Else the plan would grow with every round of a deep graph.
            visited = checkpoint(visited)
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
    return visited


def callees(edges: DataFrame, symbol: str, depth: int = 3, most: int = 10) -> DataFrame:
    """node, depth: what a symbol calls, directly or through others (itself only if it is called again)."""
    return _beyond(edges, symbol, min(max(depth, 1), most))


def callers(edges: DataFrame, symbol: str, depth: int = 3, most: int = 10) -> DataFrame:
    return _beyond(reverse(edges), symbol, min(max(depth, 1), most))


def _beyond(edges: DataFrame, symbol: str, depth: int) -> DataFrame:
    first = edges.where(F.col("src") == symbol).select(F.col("dst").alias("node")).distinct()
    if depth == 1:
        return first.withColumn("depth", F.lit(1))
    return traverse(edges, first, depth - 1).select("node", (F.col("depth") + 1).alias("depth"))


def star(reached: DataFrame, symbol: str, backward: bool) -> DataFrame:
    """Links between a symbol and what was reached: caller to target (called_by, backward) or target to callee (calls, forward)."""
    me = F.lit(symbol)
    a, b = (F.col("node"), me) if backward else (me, F.col("node"))
    return reached.select(a.alias("source"), b.alias("target"), F.lit("called_by" if backward else "calls").alias("relation"), F.lit("backward" if backward else "forward").alias("type"), "depth")


def reachable(edges: DataFrame, source: str, target: str, depth: int = 5, most: int = 20) -> DataFrame:
    """One row: is_reachable, depth (null if not)."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(True, 0)], "is_reachable boolean, depth int")
    got = traverse(edges, nodes_frame(spark, source), min(depth, most), until=target)
    return got.where(F.col("node") == target).agg((F.count(F.lit(1)) > 0).alias("is_reachable"), F.min("depth").alias("depth"))


def shortest_call_path(edges: DataFrame, source: str, target: str, depth: int = 9) -> DataFrame:
    """step, node: a path of least hops (of several the least by node, going back from the target); no rows without one."""
    got = traverse(edges, nodes_frame(edges.sparkSession, source), depth, until=target)
    return _walk_back(got, edges, source, target)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def _walk_back(levels: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The path is at most as long as the traversal was deep, so its nodes are found by one point query a step."""
    spark = edges.sparkSession
    levels = checkpoint(levels)
    end = levels.where(F.col("node") == target).select("depth").head()
    if end is None:
        return spark.createDataFrame([], "step int, node string")
    path, here = [target], target
    for d in range(end[0] - 1, -1, -1):
        before = levels.where(F.col("depth") == d).join(edges.where(F.col("dst") == here).select(F.col("src").alias("node")), "node", "left_semi")
        here = before.agg(F.min("node")).head()[0]
        path.append(here)
    return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], "step int, node string")


def common_ancestor(edges: DataFrame, a: str, b: str, depth: int = 10, most: int = 30, equal_depth: bool = False) -> DataFrame:
    """node, depth_a, depth_b: the ancestor of both with the least sum of depths (ties: the smaller id); no row without one."""
    spark, back, d = edges.sparkSession, reverse(edges), min(depth, most)
    up = [traverse(back, nodes_frame(spark, x), d).select("node", F.col("depth").alias(f"depth_{k}")) for k, x in (("a", a), ("b", b))]
    both = up[0].join(up[1], "node")
    if equal_depth:
        both = both.where("depth_a = depth_b")
    return both.orderBy(F.col("depth_a") + F.col("depth_b"), "node").limit(1)


def weighted_edges(facts: DataFrame) -> DataFrame:
    """src, dst, relation, cost: every outgoing fact, and the way from a symbol back to the file that defines it."""
    cost = F.lit(OTHER_WEIGHT)
    for p, w in EDGE_WEIGHTS.items():
        cost = F.when(F.col("relation") == p, w).otherwise(cost)
    out = facts.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("relation"))
    up = facts.where("p = 'defines'").select(F.col("o").alias("src"), F.col("s").alias("dst"), F.lit("parent_defines").alias("relation"))
    return out.withColumn("cost", cost).unionByName(up.withColumn("cost", F.lit(EDGE_WEIGHTS["defines"]))).distinct()


def cheapest_path(edges: DataFrame, source: str, target: str, depth: int = 10, branching: int = 50) -> DataFrame:
    """step, node, relation, cost: the cheapest path of at most ``depth`` steps (Bellman-Ford over an active frontier).

    From each node at most ``branching`` neighbours are followed, the cheapest first (then by id and relation): a parameter of
    the search, as is the depth. Equal ends give no rows.
    """
    spark = edges.sparkSession
    empty = spark.createDataFrame([], "step int, node string, relation string, cost int")
    if source == target:
        return empty
    # Which neighbours are followed does not depend on the frontier, so it is decided once; a task keeps ``branching`` rows a node before
    # the shuffle. The edges then lie in the shared folder and no round derives or shuffles them again.
    rank = F.row_number().over(_window(["src"], ["cost", "dst", "relation"]))
    edges = checkpoint(edges.select("src", "dst", "relation", "cost", rank.alias("rank")).where(F.col("rank") <= branching).drop("rank"))
    # ``best`` is a log: the offers of each round that were cheaper than all before.
    best = active = nodes_frame(spark, source).select("node", F.lit(0).alias("cost"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("relation"))
    rows, goal = 1, None
    for _ in range(depth):
        near = edges.join(_hint(active.select(F.col("node").alias("src"), F.col("cost").alias("so_far")), rows), "src")
        offer = near.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("so_far") + F.col("cost")).alias("cost"), F.col("src").alias("before"), "relation")).alias("m")).select("node", "m.cost", "m.before", "m.relation")
        old = best.groupBy("node").agg(F.min("cost").alias("old"))
        better = offer.join(old, "node", "left").where("old is null or cost < old").drop("old")
        if goal is not None:
            better = better.where(F.col("cost") < goal)
        active = checkpoint(better)
        rows, reached = active.agg(F.count(F.lit(1)), F.min(F.when(F.col("node") == target, F.col("cost")))).head()
        goal = reached if reached is not None else goal
        if rows == 0:
            break
        best = best.unionByName(active.select(*best.columns))
    path, here = [], target
    while here != source:
        row = best.where(F.col("node") == here).orderBy("cost").head()
        if row is None:
            return empty
        path.append((here, row["relation"], row["cost"]))
        here = row["before"]
    path.append((source, None, 0))
    return spark.createDataFrame([(i, *p) for i, p in enumerate(reversed(path))], "step int, node string, relation string, cost int")


def _window(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def trim(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle: sources and sinks are peeled off until none is left."""
    edges = checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    n, m = edges.count(), -1
    while n != m:
        kept = checkpoint(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        n, m = kept.count(), n
        edges = kept
    return edges


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """cycle, length: every simple cycle of at most ``longest`` nodes, once, written from its smallest node and closed.

    A path is only grown through nodes larger than its first, so no cycle is found twice; self calls are cycles of one.
    """
    loops = edges.where("src = dst").select(F.array("src", "dst").alias("cycle"), F.lit(1).alias("length")).distinct()
    core = trim(edges)
    step = core.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = core.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    found = loops
    for n in range(2, longest + 1):
        grown = paths.join(step, "last").where(F.col("next") >= F.element_at("path", 1))
        closed = grown.where(F.col("next") == F.element_at("path", 1)).select(F.array_append("path", F.col("next")).alias("cycle"), F.lit(n).alias("length"))
        found = found.unionByName(closed)
        if n < longest:
            paths = checkpoint(grown.where(~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last")))
    return found


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of one small graph, with an explicit stack."""
    near: dict[str, list[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_nodes: list[str] = []
    is_open: set[str] = set()
    out: list[tuple[str, str]] = []
    for root in near:
        if root in order:
            continue
        work = [(root, iter(near[root]))]
        order[root] = low[root] = len(order)
        open_nodes.append(root)
        is_open.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    open_nodes.append(nxt)
                    is_open.add(nxt)
                    work.append((nxt, iter(near[nxt])))
                    break
                if nxt in is_open:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [open_nodes.pop()]
                    while members[-1] != node:
                        members.append(open_nodes.pop())
                    is_open.difference_update(members)
                    least = min(members)
                    out += [(m, least) for m in members]
    return pd.DataFrame(out, columns=["node", "component"])


def components(edges: DataFrame, one_task_edges: int = 200_000) -> DataFrame:
    """node, component: strongly connected components; the component is its smallest node.

    Of a larger graph the edges that cannot lie on a cycle are peeled off first. If at most ``one_task_edges`` are left, one task finds
    their components; more are coloured: each round spreads the least id forward until nothing changes, then keeps what reaches its colour
    backward: those nodes are components and leave the graph. The result is the same either way.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    done = None
    rest, links = checkpoint(nodes), checkpoint(edges.select("src", "dst").where("src <> dst").distinct())
    if links.count() > one_task_edges:
        links = trim(links)
    if links.count() <= one_task_edges:
        ship(edges.sparkSession)
        found = links.withColumn("graph", F.lit(1)).groupBy("graph").applyInPandas(_tarjan, "node string, component string")
        return rest.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    while not links.isEmpty():
        live = checkpoint(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            offer = links.join(live.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            new = checkpoint(live.join(offer, "node", "left").select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("changed")))
            live, changed = new.select("node", "colour"), not new.where("changed").isEmpty()
            if not changed:
                break
        tint = live.select(F.col("node").alias("src"), F.col("colour").alias("c1")), live.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
        same = checkpoint(links.join(tint[0], "src").join(tint[1], "dst").where("c1 = c2").select("src", "dst"))
        member = traverse(reverse(same), live.where("node = colour").select("node"), 1 << 30).select("node").join(live, "node").select("node", F.col("colour").alias("component"))
        member = checkpoint(member)
        done = member if done is None else done.unionByName(member)
        rest = checkpoint(rest.join(member, "node", "left_anti"))
        keep = rest.select("node")
        links = trim(links.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi"))
    alone = rest.select("node", F.col("node").alias("component"))
    return alone if done is None else done.unionByName(alone)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, depth: pairs connected by at most ``depth`` steps, by least depth; semi-naive (only new pairs are joined again)."""
    known = checkpoint(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    new, step = known, edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    for d in range(2, depth + 1):
        pairs = new.select("src", "dst").join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        new = checkpoint(pairs.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def paths_from(edges: DataFrame, start: str, longest: int = 3) -> DataFrame:
    """path, length: every simple path from a node of at most ``longest`` steps."""
    step = edges.select(F.col("src").alias("last"), F.col("dst").alias("next")).distinct()
    grown = edges.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("last")).where("size(array_distinct(path)) = 2").distinct()
    out = grown.select("path", F.lit(1).alias("length"))
    for n in range(2, longest + 1):
        grown = checkpoint(grown.join(step, "last").where(~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last")))
        out = out.unionByName(grown.select("path", F.lit(n).alias("length")))
    return out


def called_by_facts(edges: DataFrame, topic: Column | None = None) -> DataFrame:
    """The calls turned round, as facts."""
    return edges.select((topic if topic is not None else F.lit(0)).alias("topic"), F.col("dst").alias("s"), F.lit("called_by").alias("p"), F.col("src").alias("o")).distinct()
