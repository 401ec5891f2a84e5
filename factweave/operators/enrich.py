"""Virtual facts: what follows from facts and file contents together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import search


def roles(facts: DataFrame) -> DataFrame:
    """has_role facts: what handles a route is an API handler; what is in a package of types, models or syntax is a data contract."""
    handlers = facts.where("p = 'handled_by'").select(F.col("o").alias("s"), F.lit("has_role").alias("p"), F.lit("api_handler").alias("o"))
    contracts = facts.where("p = 'in_package'").where(F.col("o").rlike("types|models|ast")).select("s", F.lit("has_role").alias("p"), F.lit("data_contract").alias("o"))
    return handlers.unionByName(contracts).distinct()


def virtual_facts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """s, p, o that facts (s, p, o) and files (file, content) imply and that are not facts yet.

    Tags of files spread to their symbols; routes are handled by symbols; references to a handled route call its API and its handler; a
    frontend file that mentions a data contract exposes it; a file exports the methods that it calls.
    """
    f = facts.select("s", "p", "o")
    routers = files.where(F.col("content").rlike(r"gin\.Default|gin\.New|\.Group|Router"))
    routes = search.routes(routers, f).groupBy("route").agg(F.max("handler").alias("handler"))
    handled = routes.select(F.col("route").alias("s"), F.lit("handled_by").alias("p"), F.col("handler").alias("o"))
    links = search.called_routes(f.unionByName(handled))
    calls_api = links.select(F.col("source").alias("s"), F.lit("calls_api").alias("p"), F.col("route").alias("o"))
    calls = links.select(F.col("source").alias("s"), F.lit("calls").alias("p"), F.col("target").alias("o"))
    models = f.where("p = 'has_role' and o = 'data_contract'").select(F.col("s").alias("model"), F.regexp_extract("s", r"(\w+)$", 1).alias("name")).where("length(name) > 3").distinct()
    front = files.where(F.col("file").rlike(r"\.(ts|tsx|js|jsx)$"))
    exposes = search.mentions(front, models.select("name")).join(models, "name").select(F.col("source").alias("s"), F.lit("exposes_model").alias("p"), F.col("model").alias("o"))
    methods = search.method_calls(files.where(F.col("file").endswith(".go")), f).select(F.col("source").alias("s"), F.lit("calls").alias("p"), F.col("target").alias("o"))
    exports = f.where("p = 'defines'").where(F.col("o").rlike(r"[:.][A-Z]\w*$")).select("s", F.lit("exports").alias("p"), "o")
    derived = reduce(DataFrame.unionByName, [search.spread_tags(f), handled, calls_api, calls, exposes, methods, exports])
    derived = derived.unionByName(roles(f.unionByName(handled))).distinct()
    return derived.join(f, ["s", "p", "o"], "left_anti")
