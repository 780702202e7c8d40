"""Queries over the graph of concepts and files, the chains of versions, and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.operators import graph as G
from anamnesis.sources.tables import table


def _implied(s: SparkSession, d: str) -> DataFrame:
    return G.extracted(table(s, d, "memories"), "memory_id", "concepts", "files")


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return G.merged(_implied(s, d), "memory_id")


def graph_page(s: SparkSession, d: str) -> DataFrame:
    return G.page(graph_edges(s, d), 100)


def graph_page_edges(s: SparkSession, d: str) -> DataFrame:
    e = graph_edges(s, d)
    return G.inside(e, G.page(e, 100))


def graph_stats(s: SparkSession, d: str) -> DataFrame:
    n = G.degrees(graph_edges(s, d))
    return n.groupBy(F.substring_index("node", ":", 1).alias("type")).agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("top_degree"))


def _start(s: SparkSession, d: str) -> DataFrame:
    return G.page(graph_edges(s, d), 1).select("node")


def graph_bfs(s: SparkSession, d: str) -> DataFrame:
    return G.reached(graph_edges(s, d), _start(s, d), 3)


def graph_cheapest(s: SparkSession, d: str) -> DataFrame:
    return G.cheapest(graph_edges(s, d), _start(s, d), 2).select("node", F.round("cost", 6).alias("cost"), "steps")


def graph_name_match(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(graph_edges(s, d)).where(F.contains("node", F.lit("token")))


def graph_expand(s: SparkSession, d: str) -> DataFrame:
    """Memories one step from those about the top concept."""
    e = _implied(s, d)
    links = e.select("memory_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    seeds = table(s, d, "memories").orderBy(F.desc("strength"), "memory_id").limit(5).select("memory_id")
    return G.expanded(G.merged(e, "memory_id"), links, seeds, "memory_id")


def _related(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("parent_id is not null and memory_id is not null")
    return m.select(F.col("memory_id").alias("source"), F.col("parent_id").alias("target"), F.lit(1).alias("weight"))


def related_within(s: SparkSession, d: str) -> DataFrame:
    """Memories within two steps of a root of versions."""
    roots = _related(s, d).groupBy("target").count().orderBy(F.desc("count"), "target").limit(10).select(F.col("target").alias("node"))
    return G.reached(_related(s, d), roots, 2)


def session_relations(s: SparkSession, d: str) -> DataFrame:
    """Confidence that a memory and its parent belong together: what they share raises it."""
    m = table(s, d, "memories").select("memory_id", "parent_id", "memory_type", F.coalesce("session_ids", F.array().cast("array<string>")).alias("ss"))
    p = m.select(F.col("memory_id").alias("parent_id"), F.col("memory_type").alias("parent_type"), F.col("ss").alias("ps"))
    shared = F.size(F.array_intersect("ss", "ps"))
    kind = F.when(F.col("memory_type") == F.col("parent_type"), 0.1).otherwise(0.0)
    return m.where("parent_id is not null").join(p, "parent_id").select("memory_id", "parent_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.least(0.1 * shared, F.lit(0.3)) + kind)), 6).alias("confidence"))


def verify_citations(s: SparkSession, d: str) -> DataFrame:
    """Per memory: cited observations, and how many of them exist."""
    o = table(s, d, "raw_observations").where("obs_id is not null").select("obs_id").distinct().withColumn("there", F.lit(1))
    c = table(s, d, "memories").select("memory_id", F.explode("source_observation_ids").alias("obs_id")).distinct()
    return c.join(o, "obs_id", "left").groupBy("memory_id").agg(F.count("*").alias("cited"), F.count("there").alias("found"))


def cascade(s: SparkSession, d: str) -> DataFrame:
    """For memories that are no longer the latest: others that share two of their concepts or more."""
    m = table(s, d, "memories").where("memory_id is not null").select("memory_id", "is_latest", F.explode(F.array_distinct("concepts")).alias("concept"))
    old = m.where("not coalesce(is_latest, true)").select(F.col("memory_id").alias("old_id"), "concept")
    new = m.where("coalesce(is_latest, true)").select("memory_id", "concept")
    return old.join(new, "concept").groupBy("old_id", "memory_id").agg(F.count("*").alias("shared")).where("shared >= 2").groupBy("old_id").agg(F.count("*").alias("siblings"))


def frontier(s: SparkSession, d: str) -> DataFrame:
    """Orders that wait for no unfinished order before them of the same customer, and how many wait for them."""
    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    needs = o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("on")).where("on is not null")
    free = G.unblocked(o.select("o_orderkey", "o_orderstatus"), needs, "o_orderkey", F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)))
    waits = needs.groupBy("on").agg(F.count("*").alias("unlocks")).withColumnRenamed("on", "o_orderkey")
    return free.join(waits, "o_orderkey", "left").select("o_orderkey", F.coalesce("unlocks", F.lit(0)).alias("unlocks"))


def integrity(s: SparkSession, d: str) -> DataFrame:
    """Counts of rows that break a rule, one row per check."""
    m, se = table(s, d, "memories"), table(s, d, "sessions")
    known = m.select(F.col("memory_id").alias("parent_id"))
    ids = se.where("session_id is not null").select("session_id").distinct()
    n = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    cited = m.select("memory_id", F.explode("session_ids").alias("session_id"))
    checks = [
        n("memory without content", m.where("coalesce(trim(content), '') = ''")),
        n("memory without project", m.where("project is null")),
        n("parent missing", m.where("parent_id is not null").join(known, "parent_id", "left_anti")),
        n("strength out of range", m.where("strength < 0 or strength > 10")),
        n("cited session missing", cited.join(ids, "session_id", "left_anti")),
        n("session without end", se.where("ended_at is null").select("session_id").distinct()),
        n("expired but latest", m.where("is_latest and forget_after < timestamp'2026-07-01'")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_page, graph_page_edges, graph_stats, graph_bfs, graph_cheapest, graph_name_match, graph_expand, related_within, session_relations, verify_citations, cascade, frontier, integrity,
    )
}

_N = "list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(x))), lambda x: length(x) > 0)"
_D = "list_transform(list_filter({c}, lambda x, i: list_position({c}, x) = i), lambda x: '{k}:' || x)"
_G = f"""n AS (SELECT memory_id, {_N.format(c="concepts")} AS c0, {_N.format(c="files")} AS f0 FROM memories WHERE memory_id IS NOT NULL),
        r AS (SELECT memory_id, {_D.format(c="c0", k="concept")} AS c, {_D.format(c="f0", k="file")} AS f FROM n),
        x AS (SELECT memory_id, flatten(list_transform(c, lambda a: list_transform(f, lambda b: {{'source': a, 'target': b}})))
                || list_transform(c[:-2], lambda a, i: {{'source': a, 'target': c[i + 1]}}) || list_transform(f[:-2], lambda a, i: {{'source': a, 'target': f[i + 1]}}) AS e FROM r),
        im AS (SELECT memory_id, e.source AS source, e.target AS target FROM (SELECT memory_id, unnest(list_filter(e, lambda v, i: list_position(e, v) = i)[1:12]) AS e FROM x) WHERE e.source <> e.target),
        ed AS (SELECT source, target, count(DISTINCT memory_id) AS weight FROM im GROUP BY ALL),
        de AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ed UNION ALL SELECT target FROM ed) GROUP BY node),
        pg AS (SELECT * FROM de ORDER BY degree DESC, node LIMIT 100),
        bo AS (SELECT source, target, max(weight) AS weight FROM (SELECT source, target, weight FROM ed UNION ALL SELECT target, source, weight FROM ed) GROUP BY ALL)"""

SQL = {
    "graph_edges": f"WITH {_G} SELECT * FROM ed",
    "graph_page": f"WITH {_G} SELECT * FROM pg",
    "graph_page_edges": f"WITH {_G} SELECT * FROM ed WHERE source IN (SELECT node FROM pg) AND target IN (SELECT node FROM pg)",
    "graph_stats": f"WITH {_G} SELECT split_part(node, ':', 1) AS type, count(*) AS nodes, sum(degree)::BIGINT AS ends, max(degree) AS top_degree FROM de GROUP BY split_part(node, ':', 1)",
    "graph_bfs": f"""WITH RECURSIVE {_G}, b AS (SELECT node, 0 AS depth FROM (SELECT node FROM pg ORDER BY degree DESC, node LIMIT 1) UNION SELECT bo.target, b.depth + 1 FROM b JOIN bo ON bo.source = b.node WHERE b.depth < 3)
        SELECT node, min(depth)::INT AS depth FROM b GROUP BY node""",
    "graph_cheapest": f"""WITH RECURSIVE {_G}, b AS (SELECT node, 0.0::DOUBLE AS cost, 0 AS steps FROM (SELECT node FROM pg ORDER BY degree DESC, node LIMIT 1)
          UNION ALL SELECT bo.target, round(b.cost + 1.0 / bo.weight, 9), b.steps + 1 FROM b JOIN bo ON bo.source = b.node WHERE b.steps < 2)
        SELECT node, round(min(cost), 6) AS cost, arg_min(steps, (cost, steps))::INT AS steps FROM b GROUP BY node""",
    "graph_name_match": f"WITH {_G} SELECT * FROM de WHERE contains(node, 'token')",
    "graph_expand": f"""WITH {_G}, li AS (SELECT DISTINCT memory_id, unnest([source, target]) AS node FROM im), se AS (SELECT memory_id FROM memories ORDER BY strength DESC NULLS LAST, memory_id LIMIT 5),
        own AS (SELECT DISTINCT node FROM li WHERE memory_id IN (SELECT memory_id FROM se)),
        no AS (SELECT node, max(s) AS s FROM (SELECT node, 0.5 / 2 AS s FROM own UNION ALL SELECT bo.target, 0.5 / 3 FROM own JOIN bo ON bo.source = own.node) GROUP BY node)
        SELECT memory_id, round(max(s)::DOUBLE, 6) AS score FROM li JOIN no USING (node) WHERE memory_id NOT IN (SELECT memory_id FROM se) GROUP BY memory_id""",
    "related_within": """WITH RECURSIVE e AS (SELECT memory_id AS a, parent_id AS b FROM memories WHERE parent_id IS NOT NULL AND memory_id IS NOT NULL), bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT b AS node FROM e GROUP BY b ORDER BY count(*) DESC, b LIMIT 10),
        w AS (SELECT node, 0 AS depth FROM r UNION SELECT bo.b, w.depth + 1 FROM w JOIN bo ON bo.a = w.node WHERE w.depth < 2)
        SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""",
    "session_relations": """SELECT m.memory_id, m.parent_id, round(greatest(0.0, least(1.0, 0.5 + least(0.1 * len(list_distinct(list_intersect(coalesce(m.session_ids, []), coalesce(p.session_ids, [])))), 0.3)
        + CASE WHEN m.memory_type = p.memory_type THEN 0.1 ELSE 0 END))::DOUBLE, 6) AS confidence FROM memories m JOIN memories p ON m.parent_id = p.memory_id""",
    "verify_citations": """SELECT memory_id, count(*) AS cited, count(o.obs_id) AS found FROM (SELECT DISTINCT memory_id, unnest(source_observation_ids) AS obs_id FROM memories) c
        LEFT JOIN (SELECT DISTINCT obs_id FROM raw_observations) o ON c.obs_id = o.obs_id GROUP BY memory_id""",
    "cascade": """WITH m AS (SELECT DISTINCT memory_id, coalesce(is_latest, true) AS latest, unnest(concepts) AS concept FROM memories WHERE memory_id IS NOT NULL)
        SELECT old_id, count(*) AS siblings FROM (SELECT a.memory_id AS old_id, b.memory_id FROM m a JOIN m b USING (concept) WHERE NOT a.latest AND b.latest GROUP BY ALL HAVING count(*) >= 2) GROUP BY old_id""",
    "frontier": """WITH n AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
        u AS (SELECT p, count(*) AS unlocks FROM n WHERE p IS NOT NULL GROUP BY p)
        SELECT o.o_orderkey, coalesce(u.unlocks, 0) AS unlocks FROM orders o LEFT JOIN u ON u.p = o.o_orderkey WHERE o.o_orderstatus <> 'F'
          AND NOT EXISTS (SELECT 1 FROM n JOIN orders q ON n.p = q.o_orderkey WHERE n.o_orderkey = o.o_orderkey AND q.o_orderstatus <> 'F')""",
    "integrity": """SELECT 'memory without content' AS "check", count(*) AS n FROM memories WHERE coalesce(trim(content), '') = ''
        UNION ALL SELECT 'memory without project', count(*) FROM memories WHERE project IS NULL
        UNION ALL SELECT 'parent missing', count(*) FROM memories WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT memory_id FROM memories WHERE memory_id IS NOT NULL)
        UNION ALL SELECT 'strength out of range', count(*) FROM memories WHERE strength < 0 OR strength > 10
        UNION ALL SELECT 'cited session missing', count(*) FROM (SELECT unnest(session_ids) AS x FROM memories) WHERE x IS NULL OR x NOT IN (SELECT session_id FROM sessions WHERE session_id IS NOT NULL)
        UNION ALL SELECT 'session without end', count(DISTINCT session_id) FROM sessions WHERE ended_at IS NULL
        UNION ALL SELECT 'expired but latest', count(*) FROM memories WHERE is_latest AND forget_after < TIMESTAMP '2026-07-01'""",
}
