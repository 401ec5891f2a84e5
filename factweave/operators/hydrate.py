"""Hydration: what is known of ids - kind, language, lines, content - and context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import number_of, symbol_file
from factweave.operators.filegraph import attributes
from factweave.sources.store import source_slice


def shallow(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, kind, language, start_line, end_line (column id of ``ids``); lines are numbers or null."""
    got = attributes(facts, ids.distinct(), ["has_kind", "has_language", "start_line", "end_line"])
    line = lambda c: number_of(c).try_cast("int")
    return ids.distinct().join(got, "id", "left").select("id", F.col("has_kind").alias("kind"), F.col("has_language").alias("language"), line("start_line").alias("start_line"), line("end_line").alias("end_line"))


def full(facts: DataFrame, ids: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """shallow plus content: the symbol's own text (symbols: id, content), else its lines of the file (files: id, content), else the whole file."""
    base = shallow(facts, ids).withColumn("file", symbol_file("id"))
    own = symbols.groupBy("id").agg(F.min("content").alias("own"))
    whole = files.groupBy(F.col("id").alias("file")).agg(F.min("content").alias("whole"))
    part = F.when(F.col("start_line") > 0, source_slice("whole", F.col("start_line"), F.col("end_line"))).otherwise(F.col("whole"))
    return base.join(own, "id", "left").join(whole, "file", "left").withColumn("content", F.coalesce("own", part)).drop("own", "whole", "file")


def symbol(facts: DataFrame, name: str, project: str, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for an id, or for the id within the project if the first is unknown; none if neither is known."""
    spark = facts.sparkSession
    wanted = spark.createDataFrame([(name, 0), (f"{project}/{name}", 1)], "id string, turn int")
    known = facts.select(F.col("s").alias("id")).unionByName(facts.select(F.col("o").alias("id"))).join(F.broadcast(wanted.select("id")), "id", "left_semi").distinct()
    first = wanted.join(known, "id", "left_semi").orderBy("turn").limit(1)
    return full(facts, first.select("id"), symbols, files)


def node_metadata(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, kind, metadata (predicate to least object of every fact that is no link), children_count."""
    mine = facts.join(ids.select(F.col("id").alias("s")).distinct(), "s", "left_semi")
    meta = mine.where("p not in ('calls', 'imports', 'defines', 'references')").groupBy("s", "p").agg(F.min("o").alias("o")).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "o")))).alias("metadata"))
    kids = mine.where("p = 'defines'").groupBy("s").agg(F.count_distinct("o").alias("children_count"))
    return ids.distinct().join(meta.withColumnRenamed("s", "id"), "id", "left").join(kids.withColumnRenamed("s", "id"), "id", "left").select("id", F.trim(F.try_element_at("metadata", F.lit("has_kind"))).alias("kind"), "metadata", F.coalesce("children_count", F.lit(0)).alias("children_count"))


#: A context block shows this many characters of a text.
BLOCK_CHARS = 2000


def context_text(content: Column | str) -> Column:
    """A content as a context block shows it: cut after BLOCK_CHARS characters, and then marked as cut."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.length(c) > BLOCK_CHARS, F.concat(F.substring(c, 1, BLOCK_CHARS), F.lit("\n... (truncated)"))).otherwise(c)


def context_block(facts: DataFrame, ids: DataFrame, most: int = 5, contents: DataFrame | None = None) -> DataFrame:
    """id, relation (defines, called_by, calls), node: at most ``most`` of each, the smallest ids: a report, so the limit is its form.

    With ``contents`` (id, content) there is a row content, too, whose node is the text as context_text shows it.
    """
    ids = ids.select("id").distinct()
    out = facts.where("p in ('calls', 'defines')").select(F.col("s").alias("id"), F.col("p").alias("relation"), F.col("o").alias("node")).join(ids, "id", "left_semi")
    back = facts.where("p = 'calls'").select(F.col("o").alias("id"), F.lit("called_by").alias("relation"), F.col("s").alias("node")).join(ids, "id", "left_semi")
    rows = out.unionByName(back).distinct()
    rank = F.row_number().over(Window.partitionBy("id", "relation").orderBy("node"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    if contents is None:
        return rows
    texts = contents.join(ids, "id", "left_semi").groupBy("id").agg(F.min("content").alias("content"))
    return rows.unionByName(texts.where("content is not null").select("id", F.lit("content").alias("relation"), context_text("content").alias("node")))


def manifest(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, n_symbols) of all files, and (short name, id): of several symbols of a name the largest id."""
    from factweave.functions.text import short_name

    d = facts.where("p = 'defines'").select(F.col("s").alias("file"), F.col("o").alias("symbol")).distinct()
    return d.groupBy("file").agg(F.count(F.lit(1)).alias("n_symbols")), d.groupBy(short_name("symbol").alias("name")).agg(F.max("symbol").alias("id"))


def summary(rows: DataFrame, s: str, p: str, top: int = 10, samples: int = 20, large: int = 50) -> DataFrame:
    """kind, value, n: a report on result rows.

    total (value null) with the number of rows; predicate and subject with the ``top`` most frequent of each; sample with the first rows
    in order as text: all of them below ``large`` rows, else ``samples``.
    """
    out = None
    for kind, c in (("predicate", p), ("subject", s)):
        one = rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(top).select(F.lit(kind).alias("kind"), "value", "n")
        out = one if out is None else out.unionByName(one)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    cols = sorted(rows.columns)
    text = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in cols))
    # At most large - 1 rows can ever be shown; which of them are depends on the total.
    first = rows.select(text.alias("value")).orderBy("value").limit(large - 1).withColumn("place", F.row_number().over(Window.orderBy("value")))
    shown = first.crossJoin(F.broadcast(total)).where((F.col("n") < large) | (F.col("place") <= samples)).select(F.lit("sample").alias("kind"), "value", F.lit(1).cast("long").alias("n"))
    return out.unionByName(total.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value"), "n")).unionByName(shown)
