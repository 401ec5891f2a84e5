"""Queries of the wide-table operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.operators import wide
from factweave.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cells(table(spark, sf_dir, "refs"), table(spark, sf_dir, "attr_defs"))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.widen(table(spark, sf_dir, "refs"), table(spark, sf_dir, "attr_defs"))


_NONE = ", ".join("'" + w.replace("'", "''") + "'" for w in wide.NO_VALUE)
_TRUE = ", ".join(f"'{w}'" for w in wide.TRUE_WORDS)
_FALSE = ", ".join(f"'{w}'" for w in wide.FALSE_WORDS)

# An independent reading of the same rules: scalar parsing in DuckDB and a window for the winner.
_TYPED = rf"""
WITH kinds AS (SELECT lower(trim(ref_predicate)) AS p, attr_name, min(value_type) AS vt FROM attr_defs WHERE ref_predicate IS NOT NULL AND attr_name IS NOT NULL GROUP BY 1, 2),
rows AS (SELECT ref_id, ref_subject, observed_at, attr_name, vt, trim(ref_object, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM refs JOIN kinds ON lower(trim(ref_predicate, ' ' || chr(9) || chr(10) || chr(13))) = p WHERE ref_subject IS NOT NULL AND ref_object IS NOT NULL),
said AS (SELECT * FROM rows WHERE t <> '' AND lower(t) NOT IN ({_NONE})),
typed AS (SELECT *,
  CASE WHEN vt = 'int' AND regexp_full_match(t, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.]0*)?') THEN CAST(TRY_CAST(regexp_replace(replace(t, ',', ''), '[.]0*$', '') AS BIGINT) AS VARCHAR)
       WHEN vt = 'double' AND regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *%?') THEN
         (CASE WHEN TRY_CAST(trim(replace(t, '%', '')) AS DOUBLE) / (CASE WHEN contains(t, '%') THEN 100 ELSE 1 END) BETWEEN 0 AND 1
               THEN printf('%.2f', round(TRY_CAST(trim(replace(t, '%', '')) AS DOUBLE) / (CASE WHEN contains(t, '%') THEN 100 ELSE 1 END), 2)) END)
       WHEN vt = 'boolean' THEN CASE WHEN lower(t) IN ({_TRUE}) THEN 'true' WHEN lower(t) IN ({_FALSE}) THEN 'false' END
       WHEN vt = 'timestamp' THEN CASE
         WHEN regexp_full_match(t, '[0-9]{{12,}}') THEN strftime(make_timestamp(CAST(TRY_CAST(t AS BIGINT) // 1000 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')
         WHEN regexp_full_match(t, '[0-9]{{5,11}}') THEN strftime(make_timestamp(TRY_CAST(t AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')
         WHEN regexp_full_match(t, '[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') THEN strftime(
           TRY_CAST(replace(replace(substr(t, 1, 19), '/', '-'), 'T', ' ') AS TIMESTAMP)
           - to_seconds(CASE WHEN length(t) = 25 THEN (CASE WHEN substr(t, 20, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(t, 21, 2) AS INT) * 3600 + CAST(substr(t, 24, 2) AS INT) * 60) ELSE 0 END), '%Y-%m-%d %H:%M:%S') END
       WHEN vt = 'string' THEN t END AS cell FROM said),
best AS (SELECT *, row_number() OVER (PARTITION BY ref_subject, attr_name ORDER BY observed_at DESC NULLS LAST, ref_id DESC, t DESC) AS rn FROM typed WHERE cell IS NOT NULL)
"""

# The attributes of attr_defs and their types, by name.
ATTRIBUTES = {
    "end_line": "BIGINT", "has_churn": "DOUBLE", "has_coverage": "DOUBLE", "has_cyclomatic_complexity": "BIGINT", "has_kind": "VARCHAR", "has_language": "VARCHAR", "has_line_count": "BIGINT", "has_parameter_count": "BIGINT",
    "has_test": "BOOLEAN", "in_package": "VARCHAR", "is_exported": "BOOLEAN", "last_modified": "TIMESTAMP", "owned_by": "VARCHAR", "requires_authentication": "BOOLEAN", "start_line": "BIGINT",
}


def _wide_column(name: str, kind: str) -> str:
    cell = f"max(CASE WHEN attr_name = '{name}' THEN cell END)"
    return f"CAST({cell} AS {kind}) AS {name}"


QUERIES = {"p3_found": p3_found, "p3_wide": lambda spark, sf_dir: p3_wide(spark, sf_dir).drop("last_modified"), "p3_wide_all": p3_wide}
SQL = {
    "p3_found": _TYPED + "SELECT ref_subject, attr_name, cell FROM best WHERE rn = 1",
    "p3_wide": _TYPED + "SELECT ref_subject, " + ", ".join(_wide_column(n, k) for n, k in ATTRIBUTES.items() if n != "last_modified") + " FROM best WHERE rn = 1 GROUP BY ref_subject",
}
