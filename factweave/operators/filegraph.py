"""Graphs on the level of files, and the node-link form in which graphs are exported."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.schema import IGNORED_PREDICATES, LITERAL_BYTES, PACKAGE_FILES
from factweave.session import with_index


def _links(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "relation").distinct()


def file_edges(edges: DataFrame) -> DataFrame:
    """source, target, weight: calls between symbols of two different files, counted per pair of files."""
    pair = edges.select(X.symbol_file("src").alias("source"), X.symbol_file("dst").alias("target")).where("source <> target")
    return pair.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def import_edges(facts: DataFrame) -> DataFrame:
    return facts.where("p = 'imports'").select(F.col("s").alias("source"), F.col("o").alias("target")).where("source <> target").groupBy("source", "target").agg(F.lit(1).cast("long").alias("weight"))


def file_graph(facts: DataFrame, file: str, lazy: bool = False) -> DataFrame:
    """source, target, relation: what a file defines and imports and, unless lazy, calls, collapsed to files."""
    own = facts.where(X.symbol_file("s") == file)
    kinds = ["defines", "imports"] + ([] if lazy else ["calls"])
    rows = own.where(F.col("p").isin(*kinds)).select(X.symbol_file("s").alias("source"), X.symbol_file("o").alias("target"), F.col("p").alias("relation"))
    return _links(rows.where("source <> target"))


def file_details(facts: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of the symbols a file defines, and the calls among them."""
    mine = facts.where((F.col("p") == "defines") & (F.col("s") == file)).select(F.col("o").alias("node")).distinct()
    calls = facts.where("p = 'calls'").join(mine.select(F.col("node").alias("s")), "s", "left_semi").join(mine.select(F.col("node").alias("o")), "o", "left_semi")
    return mine.withColumn("parent", F.lit(file)), _links(calls.select(F.col("s").alias("source"), F.col("o").alias("target"), F.lit("calls").alias("relation")))


def file_calls(edges: DataFrame, facts: DataFrame, file: str, depth: int = 2) -> DataFrame:
    """source, target, weight, depth: calls between files from one file outward (imports where it calls none), at most two steps."""
    calls = file_edges(edges)
    fallback = import_edges(facts).join(F.broadcast(calls.where(F.col("source") == file).limit(1)), F.lit(True), "left_anti")
    first = calls.where(F.col("source") == file).unionByName(fallback.where(F.col("source") == file)).withColumn("depth", F.lit(1))
    if min(depth, 2) < 2:
        return first
    near = first.select(F.col("target").alias("source")).distinct().where(F.col("source") != file)
    return first.unionByName(calls.join(near, "source", "left_semi").withColumn("depth", F.lit(2)))


def file_backbone(edges: DataFrame, file: str) -> DataFrame:
    """file, side (center, upstream, downstream), weight: the files one step away."""
    calls = file_edges(edges)
    up = calls.where(F.col("target") == file).select(F.col("source").alias("file"), F.lit("upstream").alias("side"), "weight")
    down = calls.where(F.col("source") == file).select(F.col("target").alias("file"), F.lit("downstream").alias("side"), "weight")
    center = edges.sparkSession.createDataFrame([(file, "center", 0)], "file string, side string, weight long")
    return center.unionByName(up).unionByName(down)


def backbone(edges: DataFrame, aggregate: bool = False) -> DataFrame:
    """source, target, weight: calls that cross files, by symbol or, aggregated, by pair of files (weight 1)."""
    a, b = (X.symbol_file("src"), X.symbol_file("dst")) if aggregate else (F.col("src"), F.col("dst"))
    return edges.where(X.symbol_file("src") != X.symbol_file("dst")).select(a.alias("source"), b.alias("target")).distinct().withColumn("weight", F.lit(1).cast("long"))


def package_files(facts: DataFrame, prefixes: DataFrame, most: int = PACKAGE_FILES) -> DataFrame:
    """prefix, file: for each imported package the files it stands for, at most ``most`` by id.

    A file belongs to it if its path starts with it, or if its package ends in the last part of it. Both tests are equi-joins: on the
    leading directories of a file, and on the last part of its package.
    """
    files = facts.where("p in ('type', 'has_kind', 'kind') and trim(o) = 'file'").select(F.col("s").alias("file")).distinct()
    dirs = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("file"), "/"), 1, i), "/"))
    by_path = files.select("file", F.explode(dirs).alias("prefix"))
    package = facts.where("p = 'in_package'").select(F.col("s").alias("file"), F.translate(F.trim("o"), ".", "/").alias("package")).join(files, "file", "left_semi")
    by_name = package.select("file", F.substring_index("package", "/", -1).alias("last")).distinct()
    wanted = prefixes.select("prefix").distinct()
    both = wanted.join(by_path, "prefix").select("prefix", "file").unionByName(wanted.withColumn("last", F.substring_index("prefix", "/", -1)).join(by_name, "last").select("prefix", "file")).distinct()
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("file"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def project_map(facts: DataFrame) -> DataFrame:
    """source, target: imports between files, packages expanded to their files."""
    imports = facts.where("p = 'imports'").select(F.col("s").alias("source"), F.col("o").alias("prefix")).distinct()
    files = facts.where("p in ('type', 'has_kind', 'kind') and trim(o) = 'file'").select(F.col("s").alias("prefix")).distinct()
    direct = imports.join(files, "prefix", "left_semi").select("source", F.col("prefix").alias("target"))
    packages = imports.join(files, "prefix", "left_anti")
    expanded = packages.join(package_files(facts, packages), "prefix").select("source", F.col("file").alias("target"))
    return direct.unionByName(expanded).where("source <> target").distinct()


def subgraph(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """source, target, relation: the links of a set of nodes (column node) with anything, on either end."""
    ids = ids.select("node").distinct()
    rows = facts.select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("relation"))
    left = rows.join(ids.select(F.col("node").alias("source")), "source", "left_semi")
    right = rows.join(ids.select(F.col("node").alias("target")), "target", "left_semi")
    return _links(left.select("source", "target", "relation").unionByName(right.select("source", "target", "relation")))


def graph_of_rows(rows: DataFrame, s: str, p: str | None, o: str, facts: DataFrame, drop_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of query rows: nodes carry name, kind, language and group; literals and attributes are no nodes."""
    links = rows.select(F.col(s).alias("source"), F.col(o).alias("target"), (F.col(p) if p else F.lit("related")).alias("relation")).where(~F.col("relation").isin(*IGNORED_PREDICATES))
    links = links.where((F.octet_length("target") <= LITERAL_BYTES) & ~F.col("target").contains("\n"))
    if drop_tests:
        links = links.where(~F.col("source").contains("_test.go") & ~F.col("target").contains("_test.go"))
    links = links.distinct()
    ids = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    about = attributes(facts, ids, ["has_kind", "has_language"])
    nodes = ids.join(about, "id", "left").select("id", X.base_name("id").alias("name"), F.coalesce("has_kind", F.lit("")).alias("kind"), F.coalesce("has_language", X.language_of("id")).alias("language"), X.symbol_file("id").alias("group"))
    return nodes, links


def attributes(facts: DataFrame, ids: DataFrame, predicates: list[str]) -> DataFrame:
    """id and one column per predicate: the least object, by one partially aggregated pass."""
    rows = facts.where(F.col("p").isin(*predicates)).join(ids.select(F.col("id").alias("s")), "s", "left_semi")
    return rows.groupBy(F.col("s").alias("id")).agg(*(F.min(F.when(F.col("p") == p, F.trim("o"))).alias(p) for p in predicates))


def page(nodes: DataFrame, links: DataFrame, offset: int = 0, limit: int = 100, after: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of nodes by id and the links within it.

    With ``after`` (the last id of the page before) the page is a top-k of the ids beyond it. A page by its offset is cut out of the
    nodes' places in the order, which are counted range by range.
    """
    limit = max(1, min(limit, 1000))
    if after is not None or offset == 0:
        part = nodes.where(F.col("id") > after if after is not None else F.lit(True)).orderBy("id").limit(limit)
    else:
        part = with_index(nodes, ["id"], "place").where(F.col("place").between(offset, offset + limit - 1)).drop("place")
    ids = part.select("id")
    inside = links.join(F.broadcast(ids.select(F.col("id").alias("source"))), "source", "left_semi").join(F.broadcast(ids.select(F.col("id").alias("target"))), "target", "left_semi")
    return part, inside.select(*links.columns)


def merge_graphs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.unionByName(b).dropDuplicates(key)


def symbol_files(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """target, file: the file of every symbol name (column target), null where none fits.

    In this order: the part before the colon if that is a source path; the (least) file that defines the id; of the symbols whose
    name is the part after the last dot the best one's file: ids that contain the name and are under 50 characters score higher,
    then the smaller id. Three left joins, the last two on one row a key.
    """
    t = targets.select("target").where("target is not null").distinct()
    head = F.substring_index("target", ":", 1)
    prefix = F.when(F.col("target").contains(":") & X.is_source_path(head), head)
    defines = facts.where("p = 'defines'").groupBy(F.col("o").alias("id")).agg(F.min("s").alias("defined"))
    file_of = lambda c, d: F.coalesce(F.when(F.col(c).contains(":") & X.is_source_path(F.substring_index(c, ":", 1)), F.substring_index(c, ":", 1)), F.col(d))
    named = facts.where("p = 'has_name'").select(F.col("s").alias("id"), F.col("o").alias("short")).distinct().join(defines, "id", "left").withColumn("file", file_of("id", "defined")).where("file is not null")
    score = F.col("id").contains(F.col("short")).cast("int") + (F.length("id") < 50).cast("int")
    best = named.groupBy("short").agg(F.min(F.struct((-score).alias("n"), "id", "file")).alias("b")).select("short", F.col("b.file").alias("by_name"))
    rows = t.withColumn("short", F.substring_index("target", ".", -1)).join(defines.select(F.col("id").alias("target"), "defined"), "target", "left").join(best, "short", "left")
    return rows.select("target", F.coalesce(prefix, "defined", "by_name").alias("file"))


def project_file_of(path: Column | str, project: str) -> Column:
    """The place within a project that an import path names, or an empty text: what follows the project's name in the path.

    A path that begins with the name loses it and the slash behind it; of one of three parts or more that has the name anywhere, all
    but the first part counts; any other path is external.
    """
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    after = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")
    return F.when(p.startswith(project), F.regexp_replace(p, "^" + re.escape(project + "/"), "")).when((F.size(parts) >= 3) & p.contains(project), after).otherwise("")


def internal_nodes(nodes: DataFrame, documents: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """nodes (column id) with is_internal: the file before the colon has content, or begins with a known prefix."""
    have = documents.where("length(content) > 0").select(F.col("doc_id").alias("base")).distinct().withColumn("known", F.lit(True))
    known = F.coalesce("known", F.lit(False))
    for x in prefixes:
        known = known | F.col("base").startswith(x)
    return nodes.withColumn("base", F.substring_index("id", ":", 1)).join(have, "base", "left").withColumn("is_internal", known).drop("base", "known")


def enriched_nodes(nodes: DataFrame, facts: DataFrame, contents: DataFrame) -> DataFrame:
    """nodes (id, ...) with kind, package, tags (in order) and code merged in by id; kind only where the node has none."""
    about = attributes(facts, nodes.select("id").distinct(), ["has_kind", "in_package"]).select("id", F.col("has_kind").alias("_kind"), F.col("in_package").alias("package"))
    tags = facts.where("p = 'has_tag'").select(F.col("s").alias("id"), "o").join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("tags"))
    code = contents.groupBy("id").agg(F.min("content").alias("code"))
    rows = nodes.join(about, "id", "left").join(tags, "id", "left").join(code, "id", "left")
    kind = F.coalesce(F.when(F.col("kind") != "", F.col("kind")), "_kind", F.lit("")) if "kind" in nodes.columns else F.coalesce("_kind", F.lit(""))
    return rows.withColumn("kind", kind).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("_kind")
