"""P3: attribute-value rows into one typed row per entity.

The rows are partitioned by attribute into narrow typed tables (one winner per entity and attribute, found by a partially
aggregated ``max_by``, so a subject with a third of all rows is reduced before the shuffle). The narrow tables are written
to the shared folder, read back one by one, co-partitioned by entity with a spine of all entities, and combined by a balanced
tree of joins that never shuffles again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import maybe_broadcast, own_columns, scratch_path

# Words and marks that only say that there is no value.
NO_VALUE = (
    "-", "--", "---", "–", "—", "?", "??", "???", ".", "..", "...", "*", "/", "_", "n/a", "na", "n.a.", "n.a", "#n/a", "none", "null", "nil", "nan", "unknown", "undefined", "undef", "missing", "empty", "blank", "tbd", "tba", "void",
    "not available", "not applicable", "not set", "unset", "no value", "no data", "(none)", "(null)", "(unknown)", "<none>", "<null>", "<unknown>", "[none]", "[null]", "\\n",
)
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _seconds(text: Column) -> Column:
    """Seconds since 1970 in UTC of a timestamp text, whatever the session's time zone; null if it is none."""
    rx = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
    part = lambda i: F.regexp_extract(text, rx, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    clock = (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 60)
    digits = F.regexp_replace(part(7), "[^0-9]", "")
    offset = F.when(part(7).rlike("^[+-]"), F.when(part(7).startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60)).otherwise(0)
    written = F.when(clock, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + number(4) * 3600 + number(5) * 60 + number(6) - offset)
    bare = text.try_cast("decimal(20,3)")
    epoch = F.when(F.abs(bare) >= 100_000_000_000, F.floor(bare / 1000)).otherwise(F.floor(bare)).cast("long")
    return F.when(text.rlike(r"^[+-]?\d{5,}(\.\d+)?$"), epoch).when(text.rlike(rx), written)


def trimmed(text: Column) -> Column:
    """An attribute's text without surrounding white space."""
    return F.regexp_replace(text, _BLANK, "")


def says_nothing(t: Column) -> Column:
    """Whether a trimmed text is empty or only says that there is no value."""
    return (t == "") | F.lower(t).isin(*NO_VALUE)


def readable(t: Column, value_type: str) -> Column:
    """The typed value of a trimmed text that says something, or null if it is unreadable for the type."""
    if value_type == "string":
        return t
    if value_type == "int":
        grouped = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.0*)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
        return F.when(grouped.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(grouped, r"\.0*$", "").try_cast("long"))
    if value_type == "double":
        number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?"
        v = F.when(t.rlike(rf"^{number}\s*%$"), F.regexp_replace(t, r"\s*%$", "").try_cast("double") / 100).when(t.rlike(f"^{number}$"), t.try_cast("double"))
        return F.when((v >= 0) & (v <= 1), v)
    if value_type == "boolean":
        return F.when(F.lower(t).isin(*TRUE_WORDS), True).when(F.lower(t).isin(*FALSE_WORDS), False)
    if value_type == "timestamp":
        return F.timestamp_seconds(_seconds(t))
    raise ValueError(f"unknown value type {value_type!r}")


def written(value: Column, value_type: str) -> Column:
    """A typed value as text: the form of p3_found. Timestamps are written in UTC without using the session's time zone."""
    if value_type == "double":
        return value.cast("decimal(20,10)").cast("decimal(20,2)").cast("string")
    if value_type == "timestamp":
        s = F.unix_seconds(value)
        rest = F.pmod(s, F.lit(86400))
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")).cast("string")
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        return F.concat(day, F.lit(" "), F.concat_ws(":", two(F.floor(rest / 3600)), two(F.pmod(F.floor(rest / 60), F.lit(60))), two(F.pmod(rest, F.lit(60)))))
    return value.cast("string")


def attribute_columns(defs: DataFrame) -> list[tuple[str, str]]:
    """The columns of the wide table, (name, type) by name. Their number bounds the width of a row, so it is read to the driver."""
    rows = own_columns(defs, "attr_name", "value_type").where("attr_name is not null and value_type is not null").groupBy("attr_name").agg(F.min("value_type").alias("value_type")).orderBy("attr_name").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 attributes: not a wide table")
    return [(r[0], r[1]) for r in rows]


def winners(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """ref_subject, attr_name, v (the winning text): one row per subject and attribute that has a readable value."""
    kinds = own_columns(defs, "ref_predicate", "attr_name", "value_type").where("ref_predicate is not null and attr_name is not null").withColumn("p", F.lower(F.trim("ref_predicate"))).groupBy("p", "attr_name").agg(F.min("value_type").alias("value_type"))
    rows = (
        own_columns(refs, "ref_id", "ref_subject", "ref_predicate", "ref_object", "observed_at").where("ref_subject is not null and ref_object is not null")
        .withColumn("p", F.lower(F.regexp_replace("ref_predicate", _BLANK, ""))).join(maybe_broadcast(kinds), "p")
    )
    rows = rows.select("ref_id", "ref_subject", "observed_at", "attr_name", "value_type", trimmed(F.col("ref_object")).alias("v"))
    ok = F.lit(False)
    for kind in ("string", "int", "double", "boolean", "timestamp"):
        ok = F.when(F.col("value_type") == kind, readable(F.col("v"), kind).isNotNull()).otherwise(ok)
    order = F.struct(F.col("observed_at").isNotNull(), F.col("observed_at"), F.col("ref_id"), F.col("v"))
    # Map-side partial aggregation: one row per subject and attribute leaves each task.
    return rows.where(~says_nothing(F.col("v"))).where(ok).groupBy("ref_subject", "attr_name").agg(F.max_by("v", order).alias("v"))


def widen(refs: DataFrame, defs: DataFrame, block: int = 4) -> DataFrame:
    """One row per subject: ref_subject and one typed column per attr_name of ``defs``.

    A subject without any readable value has no row. Of several readable values the one with the latest observed_at holds
    (null is the earliest), then the largest ref_id. Predicates match regardless of case and surrounding blanks; rows with a
    null subject, predicate or object are no attribute values. Extra columns are ignored. Empty tables give no rows;
    empty ``defs`` give the single column ref_subject.
    """
    spark = refs.sparkSession
    columns = attribute_columns(defs)
    if not columns:
        return own_columns(refs, "ref_subject").limit(0)
    path = scratch_path(spark, "narrow")
    number = F.lit(-1)
    for i, (name, _) in enumerate(columns):
        number = F.when(F.col("attr_name") == name, i).otherwise(number)
    winners(refs, defs).select(number.alias("attr"), "ref_subject", "v").write.partitionBy("attr").parquet(path)
    schema = "ref_subject string, v string"

    def narrow(i: int) -> DataFrame:
        """The typed narrow table of one attribute: its own files alone are read."""
        name, kind = columns[i]
        one = spark.read.schema(schema + ", attr int").parquet(path).where(F.col("attr") == i)
        return one.select("ref_subject", readable(F.col("v"), kind).alias(name))

    spine = spark.read.schema(schema + ", attr int").parquet(path).select("ref_subject").distinct()
    level = []
    for lo in range(0, len(columns), block):
        part = spine
        for i in range(lo, min(lo + block, len(columns))):
            part = part.join(narrow(i).hint("merge"), "ref_subject", "left")
        level.append(part)
    for _ in range(math.ceil(math.log2(len(level))) if len(level) > 1 else 0):
        level = [level[i].join(level[i + 1].hint("merge"), "ref_subject", "inner") if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cells(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """ref_subject, attr_name, cell: a row for each filled cell of the wide table, written as text."""
    columns = attribute_columns(defs)
    wide = widen(refs, defs)
    if not columns:
        return wide.select("ref_subject", F.lit("").alias("attr_name"), F.lit("").alias("cell"))
    pairs = F.array(*(F.struct(F.lit(n).alias("attr_name"), written(F.col(f"`{n}`"), k).alias("cell")) for n, k in columns))
    return wide.select("ref_subject", F.explode(pairs).alias("c")).select("ref_subject", "c.attr_name", "c.cell").where("cell is not null")
