"""Queries of retention, decay, eviction, versions, merging and temporal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.operators import lifecycle as L
from anamnesis.sources.tables import table

AS_OF = "2026-07-01 00:00:00"


def _accesses(s: SparkSession, d: str) -> DataFrame:
    """Uses of memories: each time a source observation of theirs was made."""
    o = table(s, d, "raw_observations").where("obs_id is not null").groupBy("obs_id").agg(F.min("ts").alias("ts"))
    links = table(s, d, "memories").select("memory_id", F.explode("source_observation_ids").alias("obs_id"))
    return links.join(o, "obs_id").where("ts is not null").select("memory_id", "ts")


def _scores(s: SparkSession, d: str) -> DataFrame:
    a = L.recent_accesses(_accesses(s, d), "memory_id", "ts")
    m = table(s, d, "memories").where("coalesce(is_latest, false) and created_at is not null").join(a, "memory_id", "left")
    used = F.coalesce("accesses", F.array().cast("array<timestamp>"))
    return m.select("memory_id", F.round(L.retention(F.col("memory_type"), F.col("created_at"), used, AS_OF), 6).alias("score"))


def retention_scores(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).withColumn("tier", L.tier(F.col("score")))


def retention_tiers(s: SparkSession, d: str) -> DataFrame:
    return retention_scores(s, d).groupBy("tier").agg(F.count("*").alias("n"))


def retention_evict(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).where("score < 0.15").orderBy("score", "memory_id").limit(50)


def access_log(s: SparkSession, d: str) -> DataFrame:
    return L.recent_accesses(_accesses(s, d), "memory_id", "ts").select("memory_id", "n", "last", F.size("accesses").alias("n_kept"))


def tier_decay(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("strength is not null and updated_at is not null")
    return m.select("memory_id", F.round(L.decayed_strength(F.col("strength"), L.days_since(F.col("updated_at"), AS_OF)), 6).alias("strength"))


def decay_sweep(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("strength is not null and updated_at is not null")
    swept = L.swept_confidence(F.col("strength") / 10, L.days_since(F.col("updated_at"), AS_OF))
    return m.select("memory_id", F.round(swept, 3).alias("confidence")).withColumn("gone", F.col("confidence") <= 0.1)


def reinforcement(s: SparkSession, d: str) -> DataFrame:
    """Concepts as lessons saved again and again: confidence after their repeats."""
    c = table(s, d, "memories").select(F.explode("concepts").alias("concept")).where("concept is not null").groupBy(F.lower("concept").alias("lesson")).agg(F.count("*").alias("n"))
    return c.select("lesson", "n", F.round(L.reinforced(F.lit(0.5), F.col("n") - 1), 6).alias("confidence"))


def evict_stale_sessions(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("summary").alias("summary"))
    old = one.where((L.days_since(F.col("started_at"), AS_OF) > 30) & (F.coalesce(F.length(F.trim("summary")), F.lit(0)) == 0))
    used = table(s, d, "memories").select(F.explode("session_ids").alias("session_id"))
    return old.join(used, "session_id", "left_anti").select("session_id")


def evict_project_cap(s: SparkSession, d: str) -> DataFrame:
    """What a cap of so many memories per project evicts, weakest first."""
    w = Window.partitionBy("project").orderBy(F.desc("strength"), F.desc("created_at"), "memory_id")
    m = table(s, d, "memories").where("project is not null").withColumn("r", F.row_number().over(w))
    return m.where("r > 10").select("project", "memory_id")


def evict_observations(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_history").where("obs_id is not null").select("obs_id", "ts", "importance").distinct()
    return f.where((L.days_since(F.col("ts"), AS_OF) > 90) & (F.col("importance") < 3)).select("obs_id")


def ttl_expired(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories").where(F.col("forget_after") < F.lit(AS_OF).cast("timestamp")).select("memory_id")


def consolidation_groups(s: SparkSession, d: str) -> DataFrame:
    """Concepts of three strong memories or more, with the eight strongest of each."""
    m = table(s, d, "memories").where("strength >= 5").select("memory_id", "strength", F.explode(F.array_distinct(F.transform("concepts", lambda c: F.lower(c)))).alias("concept"))
    n = m.groupBy("concept").agg(F.count("*").alias("n")).where("n >= 3")
    w = Window.partitionBy("concept").orderBy(F.desc("strength"), "memory_id")
    top = m.withColumn("r", F.row_number().over(w)).where("r <= 8").groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "memory_id"))), lambda x: x["memory_id"]), "|").alias("strongest"))
    return n.join(top, "concept")


def memory_versions(s: SparkSession, d: str) -> DataFrame:
    """Length of each chain of versions, by the version numbers that point back to a parent."""
    m = table(s, d, "memories")
    child = m.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return m.join(child.withColumnRenamed("parent_id", "memory_id"), "memory_id", "left").select("memory_id", "version_no", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("is_latest", F.lit(True)).alias("is_latest"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))


KEY = ["o_custkey", "o_orderpriority", "o_orderstatus"]


def edge_versions(s: SparkSession, d: str) -> DataFrame:
    v = L.edge_versions(_edges(s, d), KEY, "at", "o_orderkey")
    return v.select("o_orderkey", F.col("version").cast("int").alias("version"), F.col("valid_end").cast("string").alias("valid_end"), "is_latest")


def asof_edges(s: SparkSession, d: str) -> DataFrame:
    return L.as_of(_edges(s, d), KEY, "at", "o_orderkey", "1996-06-01 00:00:00").select(*KEY, "o_orderkey")


def differential_state(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d).where("at between timestamp'1996-01-01' and timestamp'1996-03-31'")
    return e.groupBy("o_custkey").agg(F.count("*").alias("changes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), "|").alias("edges"))


def lww_merge(s: SparkSession, d: str) -> DataFrame:
    """Two replicas of each customer's last order, kept by even and odd order numbers."""
    e = _edges(s, d).select("o_custkey", "o_orderkey", "at")
    one = lambda odd: e.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.max("at").alias("at"), F.max_by("o_orderkey", F.struct("at", "o_orderkey")).alias("o_orderkey"))
    return L.last_writer_wins(one(0), one(1), "o_custkey", "at").select("o_custkey", "o_orderkey", "is_local")


def dedup_ttl(s: SparkSession, d: str) -> DataFrame:
    """Events per user and type, and those kept if repeats within five minutes of a kept one are dropped."""
    k = L.kept_by_ttl(table(s, d, "events"), ["user_id", "event_type"], "ts", 300)
    return k.select("user_id", "event_type", "rows", F.col("kept").cast("long").alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        retention_scores, retention_tiers, retention_evict, access_log, tier_decay, decay_sweep, reinforcement, evict_stale_sessions, evict_project_cap, evict_observations, ttl_expired,
        consolidation_groups, memory_versions, edge_versions, asof_edges, differential_state, lww_merge, dedup_ttl,
    )
}

_ACC = """o AS (SELECT obs_id, min(ts) AS ts FROM raw_observations WHERE obs_id IS NOT NULL GROUP BY obs_id),
        acc AS (SELECT memory_id, ts FROM (SELECT memory_id, unnest(source_observation_ids) AS obs_id FROM memories) JOIN o USING (obs_id) WHERE ts IS NOT NULL),
        ra AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC) AS r FROM acc)"""
_NOW = "epoch_us(TIMESTAMP '2026-07-01 00:00:00')"
_KINDS = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in L.KIND_WEIGHTS.items())
_SCORES = f"""{_ACC},
        b AS (SELECT memory_id, least(count(*), 20) AS n, 0.3 * sum(CASE WHEN {_NOW} > epoch_us(ts) THEN 86400e6 / ({_NOW} - epoch_us(ts)) ELSE 0 END) AS boost FROM ra WHERE r <= 20 GROUP BY memory_id),
        sc AS (SELECT memory_id, round(least(1.0, least(1.0, CASE memory_type {_KINDS} ELSE 0.5 END + least(0.2, coalesce(n, 0) * 0.02)) * exp(-0.01 * (({_NOW} - epoch_us(created_at)) / 86400e6)) + coalesce(boost, 0)), 6)::DOUBLE AS score
               FROM memories LEFT JOIN b USING (memory_id) WHERE coalesce(is_latest, false) AND created_at IS NOT NULL),
        ti AS (SELECT memory_id, score, CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'evictable' END AS tier FROM sc)"""
_AGE = "(({now} - epoch_us({c})) / 86400e6)"
_DAYS = _AGE.format(now=_NOW, c="updated_at")
_E = "e AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate AS ts FROM orders)"

SQL = {
    "retention_scores": f"WITH {_SCORES} SELECT * FROM ti",
    "retention_tiers": f"WITH {_SCORES} SELECT tier, count(*) AS n FROM ti GROUP BY tier",
    "retention_evict": f"WITH {_SCORES} SELECT * FROM sc WHERE score < 0.15 ORDER BY score, memory_id LIMIT 50",
    "access_log": f"WITH {_ACC} SELECT memory_id, count(*) AS n, max(ts) AS last, least(count(*), 20)::INT AS n_kept FROM ra GROUP BY memory_id",
    "tier_decay": f"SELECT memory_id, round(CASE WHEN {_DAYS} > 30 THEN greatest(0.1, strength * pow(0.9, floor({_DAYS} / 30))) ELSE strength END, 6) AS strength FROM memories WHERE strength IS NOT NULL AND updated_at IS NOT NULL",
    "decay_sweep": f"""SELECT *, confidence <= 0.1 AS gone FROM (SELECT memory_id, round(CASE WHEN {_DAYS} / 7 >= 1 THEN round(greatest(0.05, strength / 10 - 0.05 * ({_DAYS} / 7)), 3) ELSE strength / 10 END, 3) AS confidence
        FROM memories WHERE strength IS NOT NULL AND updated_at IS NOT NULL)""",
    "reinforcement": """SELECT lesson, count(*) AS n, round(1 - 0.5 * pow(0.9::DOUBLE, count(*) - 1), 6) AS confidence FROM (SELECT lower(unnest(concepts)) AS lesson FROM memories) WHERE lesson IS NOT NULL GROUP BY lesson""",
    "evict_stale_sessions": f"""WITH s AS (SELECT session_id, min(started_at) AS started_at, max(summary) AS summary FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id)
        SELECT session_id FROM s WHERE {_AGE.format(now=_NOW, c="started_at")} > 30 AND coalesce(length(trim(summary)), 0) = 0 AND session_id NOT IN (SELECT x FROM (SELECT unnest(session_ids) AS x FROM memories) WHERE x IS NOT NULL)""",
    "evict_project_cap": """SELECT project, memory_id FROM (SELECT project, memory_id, row_number() OVER (PARTITION BY project ORDER BY strength DESC NULLS LAST, created_at DESC NULLS LAST, memory_id) AS r
        FROM memories WHERE project IS NOT NULL) WHERE r > 10""",
    "evict_observations": f"SELECT DISTINCT obs_id FROM file_history WHERE obs_id IS NOT NULL AND {_AGE.format(now=_NOW, c='ts')} > 90 AND importance < 3",
    "ttl_expired": "SELECT memory_id FROM memories WHERE forget_after < TIMESTAMP '2026-07-01 00:00:00'",
    "consolidation_groups": """WITH m AS (SELECT DISTINCT memory_id, strength, lower(c) AS concept FROM (SELECT memory_id, strength, unnest(concepts) AS c FROM memories WHERE strength >= 5)),
        r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY strength DESC, memory_id) AS r, count(*) OVER (PARTITION BY concept) AS n FROM m WHERE concept IS NOT NULL)
        SELECT concept, any_value(n) AS n, string_agg(memory_id, '|' ORDER BY r) AS strongest FROM r WHERE n >= 3 AND r <= 8 GROUP BY concept""",
    "memory_versions": """SELECT m.memory_id, m.version_no, coalesce(c.n, 0) AS n_children, coalesce(m.is_latest, true) AS is_latest FROM memories m
        LEFT JOIN (SELECT parent_id, count(*) AS n FROM memories WHERE parent_id IS NOT NULL GROUP BY parent_id) c ON m.memory_id = c.parent_id""",
    "edge_versions": f"""WITH {_E} SELECT o_orderkey, row_number() OVER w::INT AS version, strftime(lead(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS valid_end, lead(ts) OVER w IS NULL AS is_latest FROM e
        WINDOW w AS (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY ts, o_orderkey)""",
    "asof_edges": f"""WITH {_E} SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey FROM e WHERE ts <= TIMESTAMP '1996-06-01'
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY ts DESC, o_orderkey DESC) = 1""",
    "differential_state": f"WITH {_E} SELECT o_custkey, count(*) AS changes, string_agg(o_orderkey::VARCHAR, '|' ORDER BY ts, o_orderkey) AS edges FROM e WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' GROUP BY o_custkey",
    "lww_merge": f"""WITH {_E}, r AS (SELECT o_custkey, (o_orderkey % 2 = 0)::INT AS is_local, max(ts) AS ts, arg_max(o_orderkey, (ts, o_orderkey)) AS o_orderkey FROM e GROUP BY o_custkey, o_orderkey % 2)
        SELECT o_custkey, o_orderkey, is_local FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC, is_local DESC) = 1""",
    "dedup_ttl": """WITH RECURSIVE d AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
        k AS (SELECT user_id, event_type, min(t) AS t FROM d GROUP BY user_id, event_type
              UNION ALL SELECT k.user_id, k.event_type, (SELECT min(d.t) FROM d WHERE d.user_id = k.user_id AND d.event_type = k.event_type AND d.t > k.t + 300000000) AS t FROM k WHERE k.t IS NOT NULL),
        n AS (SELECT user_id, event_type, count(*) AS rows FROM d GROUP BY ALL)
        SELECT user_id, event_type, any_value(rows) AS rows, count(k.t) AS kept FROM n JOIN k USING (user_id, event_type) GROUP BY ALL""",
}
