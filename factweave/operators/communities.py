"""Community detection by local moves on modularity, cluster graphs and hybrid clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.schema import CLUSTER_FROM
from factweave.session import checkpoint, with_index


def communities(edges: DataFrame, resolution: float = 0.2, rounds: int = 10) -> DataFrame:
    """node, community: communities named by their smallest node; deterministic.

    Every round each node looks at its neighbours' communities and moves where modularity gains most. To keep neighbours from
    swapping places for ever, a round lets only one half of the nodes move (by a hash and the round's parity), and on equal gain
    the smaller community wins. All state is in tables: a move is two joins and two aggregates.
    """
    both = edges.where("src <> dst").select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weights = checkpoint(both.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    degree = checkpoint(weights.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).head()[0] or 1.0
    state = checkpoint(degree.select("node", "k", F.col("node").alias("c")))
    for i in range(rounds):
        sums = state.groupBy("c").agg(F.sum("k").alias("in_c"))
        links = weights.join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("to_c"))
        # The node's own community is an option even if no neighbour is in it.
        options = links.unionByName(state.select("node", "c", F.lit(0.0).alias("to_c"))).groupBy("node", "c").agg(F.sum("to_c").alias("to_c"))
        scored = options.join(sums, "c").join(state.select("node", "k", F.col("c").alias("own")), "node")
        rest = F.col("in_c") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("to_c") - resolution * F.col("k") * rest / total, 9)
        best = scored.select("node", "own", "k", "c", gain.alias("gain")).groupBy("node", "own", "k").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        moved = checkpoint(best.select("node", "k", F.when(turn, F.col("b.c")).otherwise(F.col("own")).alias("c"), (turn & (F.col("b.c") != F.col("own"))).alias("moved")))
        state = moved.select("node", "k", "c")
        if i and moved.where("moved").isEmpty() and not moved.where("moved is null").limit(1).count():
            break
    names = state.groupBy("c").agg(F.min("node").alias("community"))
    return state.join(names, "c").select("node", "community")


def numbered(members: DataFrame) -> DataFrame:
    """node, cluster_id: communities numbered from 0 by their smallest node. Only the communities are ranked, range by range."""
    ids = with_index(members.select("community").distinct(), ["community"], "cluster_id")
    return members.join(ids, "community").select("node", "cluster_id")


def cluster_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, smallest: int = CLUSTER_FROM) -> tuple[DataFrame, DataFrame]:
    """(clusters, links): super-nodes labelled by their most frequent directory, and counted links between them.

    Graphs of fewer than ``smallest`` nodes are returned as they are: each node is its own cluster.
    """
    if nodes.count() < smallest:
        members = nodes.select("node", F.col("node").alias("community"))
    member = members.join(nodes.select("node"), "node", "left_semi")
    dirs = member.select("community", X.dir_name(X.symbol_file("node")).alias("dir")).groupBy("community", "dir").agg(F.count(F.lit(1)).alias("n"))
    clusters = dirs.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), "dir")).alias("top")).select("community", "size", F.col("top.dir").alias("label"))
    a, b = member.toDF("src", "source"), member.toDF("dst", "target")
    links = edges.join(a, "src").join(b, "dst").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return clusters, links


def round_robin(ranked: DataFrame, order: list, k: int) -> DataFrame:
    """The rows of a bounded top list dealt to k clusters in turn: cluster = (rank - 1) mod k."""
    return ranked.withColumn("cluster", (F.row_number().over(Window.orderBy(*order)) - 1) % k)
