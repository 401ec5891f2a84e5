"""Queries of graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema
from factweave.functions import text as X
from factweave.operators import centrality, communities
from factweave.operators import graph as G
from factweave.queries.facts import dir_sql, file_sql, short_sql
from factweave.sources import fixtures
from factweave.sources.fixtures import EDGES_CTE, FACTS_CTE

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: All call graph queries run on resolved calls. The ends asked about: the most called node, the busiest caller, and the node in the
#: middle of most calls.
_E = EDGES_CTE
_HUB = "(SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_CALLER = "(SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_MIDDLE = "(SELECT n FROM (SELECT dst AS n, count(*) AS i FROM e GROUP BY 1) JOIN (SELECT src AS n, count(*) AS o FROM e GROUP BY 1) USING (n) ORDER BY least(i, o) DESC, n LIMIT 1)"


class Data:
    """What the queries read: facts, resolved edges, and the ends asked about (found once, so they are no part of a query)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def facts(self) -> DataFrame:
        return fixtures.facts(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return fixtures.edges(self.spark, self.sf_dir)

    def _most(self, end: str, n: int = 1) -> list[str]:
        return fixtures.once(self.spark, self.sf_dir, f"most {end} {n}", lambda: [r[0] for r in self.edges.groupBy(end).count().orderBy(F.desc("count"), end).limit(n).collect()])

    @property
    def hub(self) -> str:
        return self._most("dst")[0]

    @property
    def caller(self) -> str:
        return self._most("src")[0]

    @property
    def middle(self) -> str:
        def make() -> str:
            n = self.edges.groupBy(F.col("dst").alias("n")).agg(F.count(F.lit(1)).alias("i")).join(self.edges.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("o")), "n")
            return n.orderBy(F.least("i", "o").desc(), "n").head()[0]

        return fixtures.once(self.spark, self.sf_dir, "middle", make)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


def _bfs(start: str, depth: int, forward: bool = True, name: str = "r", table: str = "e") -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"{name}_all AS (SELECT {start} AS node, 0 AS depth UNION SELECT x.{b}, r.depth + 1 FROM {name}_all r JOIN {table} x ON x.{a} = r.node WHERE r.depth < {depth}), {name} AS (SELECT node, min(depth) AS depth FROM {name}_all GROUP BY 1)"


def _beyond(start: str, depth: int, forward: bool = True) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"r_all AS (SELECT {b} AS node, 1 AS depth FROM e WHERE {a} = {start} UNION SELECT x.{b}, r.depth + 1 FROM r_all r JOIN e x ON x.{a} = r.node WHERE r.depth < {depth}), r AS (SELECT node, min(depth) AS depth FROM r_all GROUP BY 1)"


query("resolved_calls", f"{_E} SELECT src, dst FROM e")(lambda d: G.resolve_calls(d.facts))
query("callers_direct", f"{_E} SELECT DISTINCT src AS node, 1 AS depth FROM e WHERE dst = {_HUB}")(lambda d: G.callers(d.edges, d.hub, 1))
query("callees_direct", f"{_E} SELECT DISTINCT dst AS node, 1 AS depth FROM e WHERE src = {_CALLER}")(lambda d: G.callees(d.edges, d.caller, 1))
query("callers_depth_3", f"{_E}, {_beyond(_HUB, 3, False)} SELECT node, depth FROM r")(lambda d: G.callers(d.edges, d.hub, 3))
query("callees_depth_3", f"{_E}, {_beyond(_CALLER, 3)} SELECT node, depth FROM r")(lambda d: G.callees(d.edges, d.caller, 3))
query("who_calls_graph", f"{_E}, {_beyond(_HUB, 2, False)} SELECT node AS source, {_HUB} AS target, 'called_by' AS relation, 'backward' AS type, depth FROM r")(lambda d: G.star(G.callers(d.edges, d.hub, 2), d.hub, True))
query("what_calls_graph", f"{_E}, {_beyond(_CALLER, 2)} SELECT {_CALLER} AS source, node AS target, 'calls' AS relation, 'forward' AS type, depth FROM r")(lambda d: G.star(G.callees(d.edges, d.caller, 2), d.caller, False))
query("reachability_depth_5", f"{_E}, {_bfs(_CALLER, 5)} SELECT node, depth FROM r")(lambda d: G.traverse(d.edges, G.nodes_frame(d.spark, d.caller), 5))
query("is_reachable", f"{_E}, {_bfs(_CALLER, 5)} SELECT count(*) > 0 AS is_reachable, min(depth) AS depth FROM r WHERE node = {_HUB}")(lambda d: G.reachable(d.edges, d.caller, d.hub, 5))
#: A shortest path, walked back from its end by the least predecessor.
_PATH = "walk AS (SELECT node, depth FROM r WHERE node = {0} UNION ALL SELECT min(x.src), w.depth - 1 FROM walk w JOIN {1} x ON x.dst = w.node JOIN r ON r.node = x.src AND r.depth = w.depth - 1 GROUP BY w.depth) SELECT depth AS step, node FROM walk"
query("call_path", f"{_E}, {_bfs(_CALLER, 9)}, {_PATH.format(_HUB, 'e')}")(lambda d: G.shortest_call_path(d.edges, d.caller, d.hub))
query("call_path_length", f"{_E}, {_bfs(_CALLER, 9)} SELECT depth AS hops FROM r WHERE node = {_HUB}")(lambda d: G.shortest_call_path(d.edges, d.caller, d.hub).agg(F.max("step").alias("hops")).where("hops is not null"))
_BOTH = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
query("call_path_undirected", f"{_E}, {_BOTH}, {_bfs(_HUB, 6, table='u')}, {_PATH.format(_MIDDLE, 'u')}")(lambda d: G.shortest_call_path(G.undirected(d.edges), d.hub, d.middle, 6))
_LCA_A = _HUB
_LCA_B = "(SELECT dst FROM e GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1 OFFSET 1)"


query("common_ancestor", f"{_E}, {_bfs(_LCA_A, 4, False, 'a')}, {_bfs(_LCA_B, 4, False, 'b')} SELECT a.node, a.depth AS depth_a, b.depth AS depth_b FROM a JOIN b USING (node) ORDER BY a.depth + b.depth, a.node LIMIT 1")(lambda d: G.common_ancestor(d.edges, *d._most("dst", 2), depth=4))
query("cycles_up_to_3", f"""{_E} SELECT [src, dst] AS cycle, 1 AS length FROM e WHERE src = dst
UNION ALL SELECT [a.src, a.dst, a.src], 2 FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT [a.src, b.src, c.src, a.src], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src""")(lambda d: G.cycles(d.edges, 3))
query("cycle_cores", f"{_E}, big AS (SELECT src, dst FROM e WHERE src <> dst), r AS (SELECT src AS a, dst AS b FROM big UNION SELECT r.a, big.dst FROM r JOIN big ON r.b = big.src), comp AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT node, component FROM comp UNION SELECT n, n FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) WHERE n NOT IN (SELECT node FROM comp)")(lambda d: G.components(d.edges))
query("closure_depth_2", f"{_E} SELECT src, dst, min(depth) AS depth FROM (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) GROUP BY 1, 2")(lambda d: G.closure(d.edges, 2))
query("paths_from_caller", f"""{_E}, one AS (SELECT src, dst FROM e WHERE src <> dst), p AS (SELECT [src, dst] AS path, dst AS last, 1 AS length FROM one WHERE src = {_CALLER} UNION ALL SELECT list_append(path, one.dst), one.dst, length + 1 FROM p JOIN one ON p.last = one.src WHERE length < 2 AND NOT list_contains(path, one.dst))
SELECT path, length FROM p""")(lambda d: G.paths_from(d.edges, d.caller, 2))
query("called_by_facts", f"{_E} SELECT DISTINCT 0 AS topic, dst AS s, 'called_by' AS p, src AS o FROM e")(lambda d: G.called_by_facts(d.edges))
_COST = "CASE p " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in schema.EDGE_WEIGHTS.items()) + f" ELSE {schema.OTHER_WEIGHT} END"
query("weighted_edges", f"{FACTS_CTE} SELECT DISTINCT s AS src, o AS dst, p AS relation, {_COST} AS cost FROM facts UNION SELECT o, s, 'parent_defines', 10 FROM facts WHERE p = 'defines'")(lambda d: G.weighted_edges(d.facts))


_GOAL = "(SELECT max(s) FROM facts WHERE p = 'defines')"
_STEPS = ", ".join(
    f"d{i} AS (SELECT node, cost, before, relation, turn FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, turn, before, relation) AS n FROM (SELECT * FROM d{i - 1} UNION ALL SELECT w.dst, d.cost + w.cost, d.node, w.relation, {i} FROM d{i - 1} d JOIN w ON w.src = d.node)) WHERE n = 1)" for i in range(1, 11)
)
_CHEAP = f"""{_E}, all_w AS (SELECT DISTINCT s AS src, o AS dst, p AS relation, {_COST} AS cost FROM facts UNION SELECT o, s, 'parent_defines', 10 FROM facts WHERE p = 'defines'), w AS MATERIALIZED (SELECT src, dst, relation, cost FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cost, dst, relation) AS n FROM all_w) WHERE n <= 50),
d0 AS (SELECT {file_sql(_CALLER)} AS node, 0 AS cost, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS relation, 0 AS turn), {_STEPS}, back AS (SELECT node, cost, before, relation, 0 AS n FROM d10 WHERE node = {_GOAL} UNION ALL SELECT d.node, d.cost, d.before, d.relation, back.n + 1 FROM back JOIN d10 d ON d.node = back.before)"""


def _cheapest(d: Data) -> DataFrame:
    """From the file of the busiest caller to the last file by id that defines anything, over all facts."""
    goal = fixtures.once(d.spark, d.sf_dir, "last file", lambda: d.facts.where("p = 'defines'").agg(F.max("s")).head()[0])
    return G.cheapest_path(G.weighted_edges(d.facts), d.caller.split(":")[0], goal)


query("cheapest_path", f"{_CHEAP} SELECT (SELECT max(n) FROM back) - n AS step, node, relation, cost FROM back")(_cheapest)
query("cheapest_cost", f"{_CHEAP} SELECT cost FROM d10 WHERE node = {_GOAL}")(lambda d: _cheapest(d).orderBy(F.desc("step")).limit(1).select("cost"))

# --- Centrality -----------------------------------------------------------------------------------------------------------

_DEG = "deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT o AS id, 1 AS i, 0 AS o FROM facts WHERE p IN ('calls', 'imports') UNION ALL SELECT s, 0, 1 FROM facts WHERE p IN ('calls', 'imports')) GROUP BY 1)"
_KIND = "CASE WHEN regexp_matches(lower(id), '[.:](main|init)$') THEN 'entry' WHEN regexp_matches(lower(id), ':(test|benchmark)[^:]*$') THEN 'test' ELSE 'symbol' END"


def _score(entry: bool, attention: bool) -> str:
    s = f"(in_degree + out_degree) * (CASE WHEN regexp_matches(lower(id), '[.:](main|init)') THEN 2.5 ELSE 1.0 END) * (CASE WHEN out_degree > 10 AND in_degree > 5 THEN 1.5 ELSE 1.0 END) * (CASE WHEN regexp_matches(lower(id), '{'|'.join(X.INTERFACE_WORDS)}') THEN 1.3 ELSE 1.0 END)"
    if entry:
        s += f" * (CASE WHEN {_KIND} = 'entry' THEN 2.0 ELSE 1.0 END)"
    if attention:
        n = short_sql("id")
        s += f" * (CASE WHEN regexp_matches(lower({n}), '{'|'.join(X.ATTENTION_ANYWHERE)}|^on_|callback$') OR regexp_matches({n}, '^({'|'.join(X.ATTENTION_PREFIX)})|({'|'.join(X.ATTENTION_SUFFIX)})$') THEN 1.2 ELSE 1.0 END)"
    return s


def _central(entry: bool, attention: bool) -> str:
    return f"{FACTS_CTE}, {_DEG}, sc AS (SELECT *, CAST({_score(entry, attention)} AS DOUBLE) AS score FROM deg) SELECT id AS symbol_id, round(score / (SELECT max(score) FROM sc), 6) AS centrality, in_degree, out_degree, {_KIND} AS kind, {_KIND} = 'entry' AS is_entry FROM sc"


_round = lambda df, c: df.withColumn(c, F.round(c, 6))
query("degrees", f"{FACTS_CTE}, {_DEG} SELECT id AS symbol_id, in_degree, out_degree FROM deg")(lambda d: centrality.degrees(d.facts))
query("centrality", _central(True, False))(lambda d: _round(centrality.centrality(d.facts), "centrality"))
query("centrality_service", _central(False, False))(lambda d: _round(centrality.centrality(d.facts, entry=False), "centrality"))
query("centrality_agent", _central(True, True))(lambda d: _round(centrality.centrality(d.facts, attention=True), "centrality"))
query("top_central", f"SELECT * FROM ({_central(True, False)}) ORDER BY centrality DESC, symbol_id LIMIT 20")(lambda d: _round(centrality.centrality(d.facts), "centrality").orderBy(F.desc("centrality"), "symbol_id").limit(20))
query("page_rank", f"""{FACTS_CTE}, c AS (SELECT s AS src, o AS dst FROM facts WHERE p = 'calls'), n AS (SELECT src AS node FROM c UNION SELECT dst FROM c), k AS (SELECT count(*) AS n FROM n), outs AS (SELECT src, count(*) AS m FROM c GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM k) AS rank FROM n), """ + ", ".join(f"r{i} AS (SELECT n.node, 0.15::DOUBLE / (SELECT n FROM k) + 0.85::DOUBLE * coalesce(g.g, 0) AS rank FROM n LEFT JOIN (SELECT c.dst, sum(r.rank / o.m) AS g FROM c JOIN r{i - 1} r ON r.node = c.src JOIN outs o ON o.src = c.src GROUP BY 1) g ON g.dst = n.node)" for i in range(1, 11)) + " SELECT node AS symbol_id, round(rank / (SELECT max(rank) FROM r10), 6) AS rank FROM r10")(lambda d: _round(centrality.page_rank(d.facts), "rank"))
query("normalised_degrees", f"{FACTS_CTE}, {_DEG} SELECT id AS symbol_id, round((in_degree - (SELECT min(in_degree) FROM deg)) / ((SELECT max(in_degree) FROM deg) - (SELECT min(in_degree) FROM deg)), 6) AS in_degree FROM deg")(lambda d: _round(centrality.normalise(centrality.degrees(d.facts).select("symbol_id", "in_degree"), "in_degree"), "in_degree"))
query("callers_of_middle", f"{_E}, {_beyond(_MIDDLE, 10, False)} SELECT node, depth FROM r")(lambda d: G.callers(d.edges, d.middle, 10))
query("callees_of_middle", f"{_E}, {_beyond(_MIDDLE, 10)} SELECT node, depth FROM r")(lambda d: G.callees(d.edges, d.middle, 10))
query("cycle_cores_distributed", SQL["cycle_cores"])(lambda d: G.components(d.edges, one_task_edges=0))
query("communities")(lambda d: communities.communities(d.edges))
query("communities_of_facts")(lambda d: communities.numbered(communities.communities(d.facts.where("p in ('calls', 'imports', 'defines')").select(F.col("s").alias("src"), F.col("o").alias("dst")))))


#: A partition that SQL can follow, across directories: nodes by the first digit of their hash, so the label is a real mode.
def _by_hash(d: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = d.edges.select(F.col("src").alias("node")).unionByName(d.edges.select(F.col("dst").alias("node"))).distinct()
    members = nodes.select("node", F.substring(F.md5("node"), 1, 1).alias("community"))
    return communities.cluster_graph(nodes, d.edges, members, 1) + (members,)


_MEM = f"m AS (SELECT n AS node, substr(md5(n), 1, 1) AS community FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)), dirs AS (SELECT community, {dir_sql(file_sql('node'))} AS dir, count(*) AS n FROM m GROUP BY 1, 2)"
query("cluster_nodes", f"{_E}, {_MEM} SELECT m.community, count(*) AS size, (SELECT dir FROM dirs x WHERE x.community = m.community ORDER BY x.n DESC, dir LIMIT 1) AS label FROM m GROUP BY 1")(lambda d: _by_hash(d)[0])
query("cluster_links", f"{_E}, {_MEM} SELECT a.community AS source, b.community AS target, count(*) AS weight FROM e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst WHERE a.community <> b.community GROUP BY 1, 2")(lambda d: _by_hash(d)[1])
query("numbered_clusters", f"{_E}, {_MEM} SELECT node, dense_rank() OVER (ORDER BY community) - 1 AS cluster_id FROM m")(lambda d: communities.numbered(_by_hash(d)[2]))
