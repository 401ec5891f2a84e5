"""The fact store: one partitioned table (topic, s, p, o), its scans and its sinks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema
from factweave.functions import text as X
from factweave.session import own_columns, with_index


def facts_of_refs(refs: DataFrame) -> DataFrame:
    """The set of facts in a delivery table of references: predicates in lower case without blanks, nulls left out, each fact once.

    Partial aggregation removes repeats before the shuffle, so a subject with a third of all rows is no hot key: the
    key is the whole fact.
    """
    r = own_columns(refs, "topic", "ref_subject", "ref_predicate", "ref_object").where("ref_subject is not null and ref_predicate is not null and ref_object is not null")
    return r.select("topic", F.col("ref_subject").alias("s"), F.lower(F.trim("ref_predicate")).alias("p"), F.col("ref_object").alias("o")).distinct()


@dataclass(frozen=True)
class FactStore:
    """Scans over facts(topic, s, p, o). Every method returns a lazy DataFrame; an empty text or None is a wildcard."""

    facts: DataFrame

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None, topic: int | None = None) -> DataFrame:
        """The facts that match all bound places. A constant that is nowhere gives no rows."""
        cond: Column = F.lit(True)
        for name, value in (("topic", topic), ("p", p), ("s", s), ("o", o)):
            if value is not None and value != "":
                cond = cond & (F.col(name) == value)
        return self.facts.where(cond)

    def in_topic(self, topic: int) -> FactStore:
        return FactStore(self.facts.where(F.col("topic") == topic))

    def merged(self, *topics: int) -> DataFrame:
        """Facts of several partitions, each fact once."""
        return self.facts.where(F.col("topic").isin(*topics)).select("s", "p", "o").distinct()

    def subjects_of(self, p: str, o: str) -> DataFrame:
        return self.scan(p=p, o=o).select("s").distinct()

    def of_kind(self, kind: str, p: str | None = None) -> DataFrame:
        """Facts whose subject is an entity of a kind: a pruned scan and a semi join."""
        ids = self.facts.where(F.col("p").isin("type", "has_kind", "kind") & (F.trim("o") == kind)).select("s")
        return self.scan(p=p).join(ids, "s", "left_semi")

    def about(self, s: str) -> DataFrame:
        return self.scan(s=s)

    def outgoing(self, s: str) -> DataFrame:
        return self.scan(s=s).select(F.concat_ws(" -> ", "p", "o").alias("edge")).distinct()

    def incoming(self, o: str) -> DataFrame:
        return self.scan(o=o).select(F.concat_ws(" -> ", "s", "p").alias("edge")).distinct()

    def listing(self, s: str | None = None, p: str | None = None, o: str | None = None, limit: int = schema.FACT_LIMIT) -> DataFrame:
        """Facts as text, in order, at most ``limit``; line ``limit`` + 1 says that there are more."""
        rows = self.scan(s, p, o).select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(limit + 1)
        n = F.row_number().over(_whole("s", "p", "o"))
        line = F.format_string("%s --[%s]--> %s", "s", "p", "o")
        return rows.select(n.alias("line_no"), F.when(n > limit, "(truncated)").otherwise(line).alias("line"))

    def predicates(self) -> DataFrame:
        return self.facts.select("p").distinct()

    def count(self) -> DataFrame:
        return self.facts.agg(F.count(F.lit(1)).alias("n_facts"))

    def files(self, prefix: str | None = None) -> DataFrame:
        """File ids; with a prefix those whose path, or last directory, starts with it."""
        ids = self.facts.where(F.col("p").isin("type", "has_kind", "kind") & (F.trim("o") == "file")).select(F.col("s").alias("file")).distinct()
        if not prefix:
            return ids
        last = F.substring_index(X.dir_name("file"), "/", -1)
        return ids.where(F.col("file").startswith(prefix) | last.startswith(prefix))

    def entry_points(self, limit: int = 51) -> DataFrame:
        """Symbols named main, in order."""
        return self.facts.where(F.col("p") == "defines").select(F.col("o").alias("symbol")).where(F.col("symbol").endswith(":main")).distinct().orderBy("symbol").limit(limit)

    def packages(self) -> DataFrame:
        return self.files().select(X.package_of("file").alias("package")).distinct()

    def stats(self) -> DataFrame:
        """total_facts, n_predicates, n_packages and whole facts a package."""
        packages = self.packages().agg(F.count(F.lit(1)).alias("n_packages"))
        return self.facts.agg(F.count(F.lit(1)).alias("total_facts"), F.countDistinct("p").alias("n_predicates")).crossJoin(F.broadcast(packages)).withColumn("facts_per_package", F.expr("total_facts div greatest(n_packages, 1)"))

    def missing_names(self) -> DataFrame:
        """has_name facts that could be derived but are missing (the back-fill of a migration)."""
        symbols = self.facts.where("p = 'defines'").select("topic", F.col("o").alias("s")).distinct()
        have = self.facts.where("p = 'has_name'").select("topic", "s")
        return symbols.join(have, ["topic", "s"], "left_anti").select("topic", "s", F.lit("has_name").alias("p"), X.short_name("s").alias("o"))

    # --- Sinks ------------------------------------------------------------------------------------------------------

    def append(self, more: DataFrame) -> FactStore:
        return FactStore(self.facts.unionByName(more.select("topic", "s", "p", "o")).distinct())

    def delete_subject(self, ids: DataFrame) -> FactStore:
        """Without the facts of files and of their symbols; ``ids`` has the column file."""
        gone = ids.select(F.col("file").alias("f")).distinct()
        kept = self.facts.withColumn("f", X.symbol_file("s")).join(gone, "f", "left_anti").drop("f")
        return FactStore(kept)

    def retain(self, newest: str, limit: int = schema.RETAINED_FACTS, tie: str | None = None) -> DataFrame:
        """The ``limit`` newest facts by a time column of the table (ties by s, p, o and, if given, another column), ranked range by range: no task holds them all."""
        return with_index(self.facts, [F.col(newest).desc_nulls_last(), F.col("s"), F.col("p"), F.col("o"), *([F.col(tie)] if tie else [])], "place").where(F.col("place") < limit).drop("place")

    def save(self, path: str) -> None:
        """Write partitioned by topic and predicate, sorted by subject within files, so scans prune on all three."""
        rows = self.facts.select("topic", "s", "p", "o").distinct().hint("rebalance", "topic", "p")
        rows.sortWithinPartitions("topic", "p", "s").write.mode("overwrite").partitionBy("topic", "p").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FactStore:
        return FactStore(spark.read.schema(schema.FACTS).parquet(path))


def store_by_predicate(facts: DataFrame, path: str) -> None:
    """Write facts partitioned by predicate, sorted by subject. AQE rebalances: large predicates get several files, small ones one."""
    facts.hint("rebalance", "p").sortWithinPartitions("p", "s").write.mode("overwrite").partitionBy("p").parquet(path)


def _whole(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


# --- Documents, vectors, project metadata ------------------------------------------------------------------------------


def read_content(documents: DataFrame, wanted: DataFrame, project: str) -> DataFrame:
    """id, content: the content of each wanted id, else of the id within the project, else null."""
    docs = documents.select("doc_id", "content").dropDuplicates(["doc_id"])
    first, second = docs.toDF("k1", "c1"), docs.toDF("k2", "c2")
    return wanted.select("id").join(first, F.col("id") == F.col("k1"), "left").join(second, F.concat(F.lit(project + "/"), F.col("id")) == F.col("k2"), "left").select("id", F.coalesce("c1", "c2").alias("content"))


def source_slice(content: Column | str, start: Column | int, end: Column | int) -> Column:
    """Lines start to end of a text, from 1, clamped to it; the whole text if neither is positive."""
    c = F.col(content) if isinstance(content, str) else content
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    lines = F.split(c, "\n")
    a = F.greatest(F.coalesce(lo, F.lit(1)), F.lit(1))
    b = F.when(F.coalesce(hi, F.lit(0)) <= 0, F.size(lines)).otherwise(F.least(hi, F.size(lines)))
    return F.when(a > b, "").otherwise(F.array_join(F.slice(lines, a, b - a + 1), "\n"))


def merge_table(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """An upsert: the new rows, and the old ones whose key is not among them."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def write_graph_json(nodes: DataFrame, links: DataFrame, path: str, limit: int = 100_000) -> None:
    """A graph file for viewers, indented by two. The limit bounds what the driver holds; larger graphs are written as tables."""
    n = nodes.limit(limit + 1).collect()
    m = links.limit(limit + 1).collect()
    if len(n) > limit or len(m) > limit:
        raise ValueError(f"more than {limit} nodes or links: write the tables instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"nodes": [r.asDict(True) for r in n], "links": [r.asDict(True) for r in m]}, f, indent=2, ensure_ascii=False, default=str)


def read_project(path: str) -> dict:
    """A project's description from metadata.json or a simple project.yaml (scalars, lists and one level of maps)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    out: dict = {}
    key, item = None, None
    with open(path, encoding="utf-8") as f:
        for raw in f:
            line = raw.split(" #")[0].rstrip()
            body = line.strip()
            if not body or body.startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            name, _, value = body.partition(":")
            value = value.strip().strip("\"'")
            if depth == 0:
                key, item = name, None
                out[key] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value
            elif body.startswith("- ") and ":" not in body:
                out[key] = [*(out[key] or []), body[2:].strip().strip("\"'")]
            elif not value:
                item = name
                out[key] = out[key] if isinstance(out[key], dict) else {}
                out[key][item] = {}
            elif isinstance(out[key], dict) and item:
                out[key][item][name.lstrip("- ")] = value
            else:
                out[key] = out[key] if isinstance(out[key], dict) else {}
                out[key][name.lstrip("- ")] = value
    return out


def list_projects(root: str) -> list[dict]:
    """The projects below a folder: one per directory, described by its metadata.json where there is one."""
    out = []
    for name in sorted(os.listdir(root)):
        folder = os.path.join(root, name)
        if os.path.isdir(folder) and not name.startswith("."):
            meta = os.path.join(folder, "metadata.json")
            out.append({"id": name, "name": name, "description": ""} | ({k: v for k, v in read_project(meta).items() if k in ("name", "description")} if os.path.exists(meta) else {}))
    return out
