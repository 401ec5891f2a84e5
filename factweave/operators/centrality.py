"""Degree centrality with architectural boosts, PageRank and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave import schema
from factweave.functions import text as X
from factweave.session import checkpoint


def degrees(facts: DataFrame, predicates: tuple[str, ...] = schema.CALL_LIKE) -> DataFrame:
    """symbol_id, in_degree, out_degree over facts of some relations: one union of both ends and one aggregate."""
    rows = facts.where(F.col("p").isin(*predicates))
    ends = rows.select(F.col("o").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(rows.select(F.col("s").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("symbol_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _boost(entry: bool, attention: bool) -> Column:
    low = F.lower("symbol_id")
    b = F.when(low.rlike("[.:](main|init)"), schema.BOOST_MAIN).otherwise(1.0)
    if entry:
        b = b * F.when(F.col("kind") == "entry", schema.BOOST_ENTRY).otherwise(1.0)
    b = b * F.when((F.col("out_degree") > 10) & (F.col("in_degree") > 5), schema.BOOST_HUB).otherwise(1.0) * F.when(X.is_interface_like("symbol_id"), schema.BOOST_INTERFACE).otherwise(1.0)
    return b * F.when(X.is_attention_worthy(X.short_name("symbol_id")), schema.BOOST_ATTENTION).otherwise(1.0) if attention else b


def centrality(facts: DataFrame, entry: bool = True, attention: bool = False) -> DataFrame:
    """symbol_id, centrality (largest 1), in_degree, out_degree, kind, is_entry. ``entry`` and ``attention`` choose the boosts."""
    d = degrees(facts).withColumn("kind", X.infer_kind("symbol_id"))
    d = d.withColumn("score", (F.col("in_degree") + F.col("out_degree")) * _boost(entry, attention))
    top = d.agg(F.max("score").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("symbol_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("centrality"), "in_degree", "out_degree", "kind", (F.col("kind") == "entry").alias("is_entry"))


def top_central(facts: DataFrame, k: int = 20, **options: bool) -> DataFrame:
    return centrality(facts, **options).orderBy(F.col("centrality").desc(), "symbol_id").limit(k)


def page_rank(facts: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """symbol_id, rank (largest 1): PageRank on calls as facts; repeated edges count, dangling mass is not passed on.

    Edges carry their share of the source's rank, so a round is one join on the source and one partially aggregated sum; the
    edges keep their partitioning from round to round.
    """
    edges = facts.where("p = 'calls'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    shares = checkpoint(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("n")).alias("share")))
    nodes = checkpoint(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        given = shares.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
        ranks = nodes.join(given, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("g", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            ranks = checkpoint(ranks)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select(F.col("node").alias("symbol_id"), (F.col("rank") / F.col("top")).alias("rank"))


def normalise(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column scaled to 0..1; 1 for all if they are equal."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(column, F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")
