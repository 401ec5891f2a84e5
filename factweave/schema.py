"""Schemas, predicate names and limits of the facts engine."""

from __future__ import annotations

from pyspark.sql import types as T

FACTS = T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("p", T.StringType()), T.StructField("o", T.StringType())])
DOCUMENTS = T.StructType([
    T.StructField("topic", T.IntegerType()), T.StructField("doc_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("package", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])),
])
VECTORS = T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
FILE_HASHES = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("mtime", T.LongType())])

# Relations that link code to code.
CALL_LIKE = ("calls", "imports")
# Weights of the relations in weighted paths; every other relation costs OTHER_WEIGHT.
EDGE_WEIGHTS = {"calls": 1, "calls_api": 1, "handled_by": 1, "references": 1, "exports": 1, "imports": 10, "defines": 10, "in_package": 10}
OTHER_WEIGHT = 5
# Boosts of degree centrality.
BOOST_MAIN, BOOST_ENTRY, BOOST_HUB, BOOST_INTERFACE, BOOST_ATTENTION = 2.5, 2.0, 1.5, 1.3, 1.2
# Limits of the service's operations.
RESULT_LIMIT, SEARCH_LIMIT, FACT_LIMIT, VECTOR_MAX, PACKAGE_FILES, CLUSTER_FROM, RETAINED_FACTS = 1000, 50, 50, 50, 10, 500, 5_000_000
LITERAL_BYTES = 200
# Predicates that are attributes of a node rather than links of a graph.
IGNORED_PREDICATES = ("source_code", "line_number", "start_line", "end_line")
SOURCE_EXTENSIONS = (".go", ".ts", ".js", ".jsx", ".tsx", ".py", ".java", ".cpp", ".c", ".rs", ".swift", ".kt", ".scala", ".rb", ".php", ".cs", ".vue", ".svelte", ".html", ".css")
INGESTED_EXTENSIONS = (".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".md")
SKIPPED_DIRS = ("node_modules", ".git", "dist", "build", ".next")
