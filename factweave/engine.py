"""The engine: one method for each operation of the service, over one project's tables."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave import schema
from factweave.functions import text as X
from factweave.operators import centrality, communities, enrich, filegraph, hydrate, search
from factweave.operators import graph as G
from factweave.operators.rules import Rules
from factweave.plans import agent, compiler, nl
from factweave.plans.datalog import QueryError, validate
from factweave.plans.registry import Registry
from factweave.session import checkpoint
from factweave.sources.store import FactStore, source_slice

# Parts of texts that are refused at the edge of the engine.
_UNSAFE = re.compile(r"\x00|\.\.[/\\]|<script|javascript:|;\s*(?:drop|delete|insert|update)\s|\bunion\s+select\b|--\s*$", re.I)


def check_text(value: str, limit: int = 500, name: str = "text") -> str:
    """A trimmed text that is neither empty, too long nor unsafe."""
    value = value.replace("\x00", "").strip()
    if not value:
        raise QueryError(f"{name} is empty")
    if len(value) > limit:
        raise QueryError(f"{name} is longer than {limit} characters")
    if _UNSAFE.search(value):
        raise QueryError(f"{name} is not allowed")
    return value


class RowCache:
    """Kept results: a row set lives ``seconds`` and at most ``most`` are kept, the oldest going first.

    The rows are persisted by Spark (memory, then disk) when they are first read; a part that is lost with its executor is computed
    again from the lineage.
    """

    def __init__(self, seconds: float | None = 300.0, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.kept: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.kept:
            at, rows = self.kept[key]
            if self.seconds is None or self.clock() - at < self.seconds:
                return rows
            self._drop(key)
        rows = make().persist()
        self.kept[key] = (self.clock(), rows)
        while len(self.kept) > self.most:
            self._drop(next(iter(self.kept)))
        return rows

    def _drop(self, key: tuple) -> None:
        self.kept.pop(key)[1].unpersist()

    def clear(self) -> None:
        for key in list(self.kept):
            self._drop(key)


class Engine:
    """facts (topic, s, p, o); documents (doc_id, content), symbols (id, content) and vectors (id, embedding) are optional."""

    def __init__(self, facts: DataFrame, documents: DataFrame | None = None, symbols: DataFrame | None = None, vectors: DataFrame | None = None, project: str = ""):
        self.store, self.facts, self.project = FactStore(facts), facts, project
        self.documents, self.symbols_text, self.vectors = documents, symbols, vectors
        self.registry = Registry()
        # Answers of queries age; the map and the calls of files stay until facts are written.
        self._cache, self._views = RowCache(), RowCache(seconds=None)
        self.spark = facts.sparkSession

    @cached_property
    def edges(self) -> DataFrame:
        """The resolved call graph, made once; the checkpoint outlasts lost executors."""
        return checkpoint(G.resolve_calls(self.facts))

    # Queries
    def query(self, text: str, limit: int = schema.RESULT_LIMIT, topic: int | None = None) -> DataFrame:
        """Rows of a query or of a named query; they are kept by topic, text and limit."""

        def make() -> DataFrame:
            facts = self.facts if topic is None else self.facts.where(F.col("topic") == topic)
            if text.strip() in self.registry.queries:
                return self.registry.execute(text.strip(), facts, limit=limit)
            problem = validate(text)
            if problem:
                raise QueryError(problem)
            return compiler.compile_query(text, facts, limit)

        return self._cache.get((topic, text.strip(), limit), make)

    def query_graph(self, text: str, drop_tests: bool = False) -> tuple[DataFrame, DataFrame]:
        rows = self.query(text)
        if len(rows.columns) < 2:
            raise QueryError("a graph needs two variables")
        cols = rows.columns
        return filegraph.graph_of_rows(rows, cols[0], cols[1] if len(cols) > 2 else None, cols[-1] if len(cols) > 2 else cols[1], self.facts, drop_tests)

    def execute(self, name: str, values: dict[str, str] | None = None) -> DataFrame:
        return self.registry.execute(name, self.facts, values)

    def invalidate(self) -> None:
        """Forget kept rows and the call graph, after facts were written."""
        self._cache.clear()
        self._views.clear()
        self.__dict__.pop("edges", None)

    # Listings
    def summary(self) -> DataFrame:
        return self.store.stats()

    def predicates(self) -> DataFrame:
        return self.store.predicates()

    def symbols(self, text: str) -> DataFrame:
        return search.symbols_like(self.facts, check_text(text))

    def files(self, prefix: str | None = None) -> DataFrame:
        return self.store.files(prefix)

    def source(self, id_: str, start: int = 0, end: int = 0) -> DataFrame:
        rows = self._documents().where(F.col("doc_id").isin(id_, f"{self.project}/{id_}")).orderBy((F.col("doc_id") != id_).cast("int")).limit(1)
        return rows.select("doc_id", source_slice("content", start, end).alias("content"))

    def hydrate(self, id_: str) -> DataFrame:
        files = self._documents().select(F.col("doc_id").alias("id"), "content")
        return hydrate.symbol(self.facts, id_, self.project, self.symbols_text if self.symbols_text is not None else files, files)

    def node_metadata(self, id_: str) -> DataFrame:
        return hydrate.node_metadata(self.facts, self.spark.createDataFrame([(id_,)], "id string"))

    # Graphs
    def graph(self, file: str, lazy: bool = False) -> DataFrame:
        return filegraph.file_graph(self.facts, file, lazy)

    def graph_page(self, cursor: dict | None = None) -> tuple[DataFrame, DataFrame, dict | None]:
        """One page of the whole graph, and the cursor of the next (None at the end)."""
        at = {"offset": 0, "limit": 100, "after": None} | (cursor or {})
        nodes, links = filegraph.graph_of_rows(self.facts, "s", "p", "o", self.facts)
        part, inside = filegraph.page(nodes, links, at["offset"], at["limit"], at["after"])
        last = part.agg(F.max("id")).head()[0]
        more = last is not None and not nodes.where(F.col("id") > last).isEmpty()
        return part, inside, {"offset": at["offset"] + at["limit"], "limit": at["limit"], "after": last, "sort_by": "id"} if more else None

    def manifest(self) -> tuple[DataFrame, DataFrame]:
        return hydrate.manifest(self.facts)

    def map(self) -> DataFrame:
        return self._views.get(("map",), lambda: filegraph.project_map(self.facts))

    def file_details(self, file: str) -> tuple[DataFrame, DataFrame]:
        return filegraph.file_details(self.facts, file)

    def file_calls(self, file: str, depth: int = 2) -> DataFrame:
        return self._views.get(("calls", file, depth), lambda: filegraph.file_calls(self.edges, self.facts, file, depth))

    def file_backbone(self, file: str) -> DataFrame:
        return filegraph.file_backbone(self.edges, file)

    def backbone(self, aggregate: bool = False) -> DataFrame:
        return filegraph.backbone(self.edges, aggregate)

    def subgraph(self, ids: list[str]) -> DataFrame:
        return filegraph.subgraph(self.facts, G.nodes_frame(self.spark, *ids))

    # Call graph
    def who_calls(self, symbol: str, depth: int = 1) -> DataFrame:
        return G.star(G.callers(self.edges, symbol, depth), symbol, True)

    def what_calls(self, symbol: str, depth: int = 1) -> DataFrame:
        return G.star(G.callees(self.edges, symbol, depth), symbol, False)

    def reachable(self, source: str, target: str, depth: int = 5) -> DataFrame:
        return G.reachable(self.edges, source, target, depth)

    def cycles(self, longest: int = 4) -> DataFrame:
        return G.cycles(self.edges, longest)

    def common_ancestor(self, a: str, b: str, depth: int = 10) -> DataFrame:
        return G.common_ancestor(self.edges, a, b, depth)

    def flow(self, source: str, target: str) -> DataFrame:
        return G.shortest_call_path(self.edges, source, target)

    def path(self, source: str, target: str) -> DataFrame:
        """The cheapest path of symbols; if there is none, that of their files."""
        edges = G.weighted_edges(self.facts)
        found = G.cheapest_path(edges, source, target)
        a, b = source.split(":")[0], target.split(":")[0]
        return G.cheapest_path(edges, a, b) if found.isEmpty() and (a, b) != (source, target) else found

    def enrich_called_by(self) -> DataFrame:
        return G.called_by_facts(self.edges)

    def enrich(self, files: DataFrame) -> DataFrame:
        return enrich.virtual_facts(self.facts, files)

    # Ranking, clusters, vectors
    def central(self, k: int = 20) -> DataFrame:
        return centrality.top_central(self.facts, k)

    def communities(self) -> DataFrame:
        links = self.facts.where("p in ('calls', 'imports', 'defines')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
        return communities.numbered(communities.communities(links))

    def cluster(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.edges.select(F.col("src").alias("node")).unionByName(self.edges.select(F.col("dst").alias("node"))).distinct()
        return communities.cluster_graph(nodes, self.edges, communities.communities(self.edges))

    def semantic_search(self, query: list[float], k: int = 10, least: float | None = None, predicate: str | None = None, value: str | None = None) -> DataFrame:
        keep = self.store.subjects_of(predicate, value).withColumnRenamed("s", "id") if predicate and value else None
        return search.nearest(self._vectors(), "id", "embedding", query, k, least, keep)

    def hybrid_clusters(self, query: list[float], k: int = 5, top: int = 50) -> DataFrame:
        return communities.round_robin(search.nearest(self._vectors(), "id", "embedding", query, top), [F.col("score").desc(), F.col("id")], k)

    def fuzzy(self, text: str) -> DataFrame:
        return search.fuzzy(self.facts.where("p = 'defines'").select(F.col("o").alias("symbol")), "symbol", check_text(text))

    def rules(self) -> Rules:
        return Rules(self.facts)

    # Questions and plans
    def ask(self, question: str) -> dict:
        """Classify, query, answer. The rows shown are bounded by the result limit."""
        question = check_text(question, 1000, "question")
        intent = nl.classify(question)
        symbols = [r[0] for t in intent.targets for r in search.names_like(self.facts, t).collect()] if intent.name in ("who_calls", "what_calls", "explain", "summarize") else list(intent.targets)
        queries = nl.to_query(intent, symbols)
        call = nl.tool_call(queries[0])
        if call:
            ends = [r[0] for t in intent.targets[:2] for r in search.names_like(self.facts, t, 1).collect()]
            rows = G.shortest_call_path(G.undirected(self.edges), *ends) if len(ends) == 2 else self.spark.createDataFrame([], "step int, node string")
            rows = rows.select("node")
        else:
            parts = [compiler.compile_query(q, self.facts) for q in queries]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p, allowMissingColumns=True)
            rows = rows.distinct()
        shown = [r.asDict() for r in rows.limit(schema.RESULT_LIMIT).collect()]
        # The rows shown are bounded, their number is not.
        total = len(shown) if len(shown) < schema.RESULT_LIMIT else rows.count()
        return {"intent": intent.name, "confidence": intent.confidence, "queries": queries, "total": total, "answer": nl.answer(intent, shown, total)}

    def run_plan(self, plan: str | list[agent.Step]) -> list[agent.Step]:
        return agent.Plan(self.facts, agent.read_plan(plan) if isinstance(plan, str) else plan).execute()

    def work(self, request: str, act: Callable[[agent.Turn], str] | None = None) -> agent.Turn:
        """One turn of the loop: observe, orient, decide, verify, act (by default an answer from the rows)."""
        return agent.Loop(self.facts, lambda text: search.names_like(self.facts, text), act or (lambda turn: self.ask(turn.request)["answer"])).run(check_text(request, agent.MAX_CHARS, "request"))

    def symbol_files(self, names: DataFrame) -> DataFrame:
        return filegraph.symbol_files(self.facts, names)

    def _documents(self) -> DataFrame:
        if self.documents is None:
            raise QueryError("the engine has no documents")
        return self.documents

    def _vectors(self) -> DataFrame:
        if self.vectors is None:
            raise QueryError("the engine has no vectors")
        return self.vectors


def topic_of(project: str) -> int:
    return X.topic_id(project)
