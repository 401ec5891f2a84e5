"""Incremental ingestion: what changed since the last run, and the tables that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.sources.store import FactStore, merge_table
from factweave.sources.tree import extract, facts_of_tree


def hashes(files: DataFrame) -> DataFrame:
    """path, hash (SHA-256 of the content), mtime."""
    return files.select("path", F.sha2("content", 256).alias("hash"), "mtime")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted, unchanged) of two hash tables, by one outer join."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged").alias("change"))


def update(store: FactStore, old_hashes: DataFrame, files: DataFrame, topic: int) -> tuple[FactStore, DataFrame, DataFrame]:
    """(facts, hashes, changes) after a run: facts of changed and deleted files and of their symbols go, those of new texts come.

    Imports are resolved against all files of the tree, so an incremental run gives the facts that a full one gives.
    """
    diff = changes(old_hashes, hashes(files))
    touched = diff.where("change in ('changed', 'deleted')").select(F.col("path").alias("file"))
    fresh = files.join(diff.where("change in ('added', 'changed')").select("path"), "path", "left_semi")
    kept = store.delete_subject(touched)
    return kept.append(facts_of_tree(files, extract(fresh), topic)), hashes(files), diff


def merge_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_table(old, new, ["path"])
