"""Queries of profiles, patterns, facets, timelines, metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.catalog.retrieval import _DOC, _SIMPLE, _TOK
from anamnesis.functions import text as T
from anamnesis.operators import analytics as A
from anamnesis.operators import lexical
from anamnesis.sources.tables import table

AS_OF = "2026-07-01 00:00:00"


def profile_top_concepts(s: SparkSession, d: str) -> DataFrame:
    return A.top_values(table(s, d, "memories"), "project", "concepts", 15).select("project", F.col("value").alias("concept"), "n")


def profile_top_files(s: SparkSession, d: str) -> DataFrame:
    return A.top_values(table(s, d, "memories"), "project", "files", 15).select("project", F.col("value").alias("file"), "n")


def profile_summary(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sessions").where("session_id is not null").dropDuplicates(["session_id"])
    return one.groupBy("project").agg(F.count("*").alias("sessions"), F.sum("observation_count").alias("observations"), F.count("summary").alias("summaries"), F.max("started_at").alias("last_started"))


def important_titles(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_history").where("importance >= 7 and title is not null").groupBy("session_id")
    return f.agg(F.max_by("title", F.struct("importance", "obs_id")).alias("title"), F.max("importance").alias("importance"))


def cochange_pairs(s: SparkSession, d: str) -> DataFrame:
    return A.cochanged(table(s, d, "file_history"), "session_id", "file_path", 3)


def order_copurchase(s: SparkSession, d: str) -> DataFrame:
    return A.cochanged(table(s, d, "lineitem"), "l_orderkey", "l_partkey", 3)


def error_repeat(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_history").where("obs_id is not null").dropDuplicates(["obs_id"])
    return A.repeated_titles(f, "title", 2)


def rules(s: SparkSession, d: str) -> DataFrame:
    pairs = A.cochanged(table(s, d, "file_history"), "session_id", "file_path", 4)
    return pairs.select(F.format_string("When modifying %s, also check %s (changed together %d times)", "file_a", "file_b", "frequency").alias("rule"))


def _facets(s: SparkSession, d: str) -> DataFrame:
    return A.facets(table(s, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


WANTED = [("p_brand", "Brand#1"), ("p_size", "7")]


def facet_match_all(s: SparkSession, d: str) -> DataFrame:
    f = A.facets(table(s, d, "timeline_events"), "event_id", ["kind", "tool_name"])
    return A.matching(f, [("kind", "tool_call"), ("tool_name", "Read")], True).select("target_id")


def facet_match_any(s: SparkSession, d: str) -> DataFrame:
    f = A.facets(table(s, d, "timeline_events"), "event_id", ["kind", "tool_name"])
    return A.matching(f, [("kind", "prompt"), ("tool_name", "Read")], False)


def facet_stats(s: SparkSession, d: str) -> DataFrame:
    return _facets(s, d).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def facet_dimensions(s: SparkSession, d: str) -> DataFrame:
    return _facets(s, d).groupBy("dimension").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def facet_values(s: SparkSession, d: str) -> DataFrame:
    """Values per target and dimension, sorted and joined."""
    f = A.facets(table(s, d, "memories"), "memory_id", ["memory_type", "agent_id", "project"])
    return f.groupBy("target_id", "dimension").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values"))


def majority_project(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min("project").alias("project"))
    links = table(s, d, "memories").select("memory_id", F.explode("session_ids").alias("session_id")).join(one, "session_id")
    return A.majority(links, "memory_id", "project")


def timeline_around(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "timeline_events").where("event_id is not null").dropDuplicates(["event_id"]).select("event_id", "session_id", "ts", "kind")
    return A.around(e, "ts", "event_id", "2026-03-15 12:00:00").select(F.col("relative").cast("int").alias("relative"), "event_id", "kind")


def timeline_keyword(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories")
    word = F.lit("retry")
    hit = F.contains(F.lower("title"), word) | F.contains(F.lower("content"), word) | F.exists("concepts", lambda c: F.contains(F.lower(c), word))
    return m.where(hit & F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), "memory_id").limit(20).select("memory_id", "created_at")


def sliding_context(s: SparkSession, d: str) -> DataFrame:
    """Important observations with the titles of three rows before and two after them in their session."""
    f = table(s, d, "file_history").where("obs_id is not null").dropDuplicates(["obs_id"])
    w = Window.partitionBy("session_id").orderBy("ts", "obs_id").rowsBetween(-3, 2)
    f = f.withColumn("context", F.array_join(F.collect_list(F.coalesce("title", F.lit("-"))).over(w), " / "))
    return f.where("importance >= 4").select("obs_id", "context")


def file_history_topk(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "file_history").where("obs_id is not null and file_path is not null and importance >= 4").dropDuplicates(["obs_id"])
    w = Window.partitionBy("file_path").orderBy(F.desc("importance"), F.desc("ts"), "obs_id")
    return f.withColumn("place", F.row_number().over(w)).where("place <= 5").select("file_path", "obs_id", "importance", F.col("place").cast("int").alias("place"))


def replay_timeline(s: SparkSession, d: str) -> DataFrame:
    """Raw observations as replay events: kind, offset in their session, and how long they would take to read."""
    o = table(s, d, "raw_observations").where("obs_id is not null").groupBy("obs_id").agg(F.min(F.struct("received_at", "session_id", "ts", "hook_type", "user_prompt", "assistant_response", "tool_input", "tool_output")).alias("o")).select("obs_id", "o.*")
    hook = F.col("hook_type")
    kind = F.when(hook.isin("session_start", "session_end"), hook).when(hook == "prompt_submit", "prompt").when((hook == "stop") & (F.length("assistant_response") > 0), "response")
    kind = kind.when(hook == "pre_tool_use", "tool_call").when(hook == "post_tool_use", "tool_result").when(hook == "post_tool_failure", "tool_error").otherwise("hook")
    o = o.withColumn("kind", kind)
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    chars = F.when(F.col("kind") == "prompt", n("user_prompt")).when(F.col("kind") == "response", n("assistant_response")).otherwise(0) + n("tool_input") + n("tool_output")
    started = o.groupBy("session_id").agg(F.min("ts").alias("t0"))
    o = o.join(started, "session_id")
    ms = F.when(chars == 0, 300).otherwise(F.greatest(F.lit(300), F.least(F.lit(20000), F.round(chars * 25))))
    return o.select("obs_id", "kind", (F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / 1000)).alias("offset_ms"), ms.cast("long").alias("duration_ms"))


def function_metrics(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") > 50).alias("n_high"), F.max("ts").alias("last_ts"))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return A.nearest_rank(table(s, d, "events"), ["event_type"], "value", [50, 90, 99])


def audit_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-25'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type")


def followup_rate(s: SparkSession, d: str) -> DataFrame:
    """Per user: searches, and those that follow another one of a different kind within half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("user_id", "ts", "event_id", "event_type", F.lag("ts").over(w).alias("last_ts"), F.lag("event_type").over(w).alias("last_type"))
    follow = (F.unix_micros("ts") - F.unix_micros("last_ts") <= 1800 * 10**6) & (F.col("event_type") != F.col("last_type"))
    return e.groupBy("user_id").agg(F.count("*").alias("searches"), F.count_if(follow).alias("followups"), F.round(F.avg(F.coalesce(follow, F.lit(False)).cast("int")), 6).alias("rate"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    """Events per hour and type: our own extension beside the row windows."""
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events with gaps of at most two hours."""
    e = table(s, d, "events").where("user_id is not null").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("started"), "n")


def session_counts(s: SparkSession, d: str) -> DataFrame:
    """Sessions as their raw observations show them: rows, first prompt, first and last time."""
    o = table(s, d, "raw_observations").where("session_id is not null and obs_id is not null").groupBy("obs_id", "session_id").agg(F.min(F.struct("ts", "user_prompt")).alias("o"))
    prompt = F.substring(F.trim(F.regexp_replace("o.user_prompt", r"\s+", " ")), 1, 200)
    return o.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by(F.when(F.length("o.user_prompt") > 0, prompt), F.when(F.length("o.user_prompt") > 0, F.struct("o.ts", "obs_id"))).alias("first_prompt"), F.min("o.ts").alias("first_ts"), F.max("o.ts").alias("last_ts"))


def sessions_with_memories(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sessions").where("session_id is not null").dropDuplicates(["session_id"]).select("session_id", "status")
    n = table(s, d, "memories").select("memory_id", F.explode(F.array_distinct("session_ids")).alias("session_id")).groupBy("session_id").agg(F.count("*").alias("n"))
    return one.join(n, "session_id", "left").select("session_id", "status", F.coalesce("n", F.lit(0)).alias("n_memories"))


def commit_sessions(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sessions").where("session_id is not null").dropDuplicates(["session_id"])
    return one.select(F.explode("commit_shas").alias("sha"), "session_id", "project").groupBy("sha").agg(F.array_join(F.sort_array(F.collect_set("session_id")), "|").alias("sessions"), F.min("project").alias("project"))


def memory_page(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "memories").where("coalesce(is_latest, true)")
    return m.orderBy(F.desc("updated_at"), "memory_id").offset(20).limit(50).select("memory_id", "updated_at", "agent_id")


def retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    """Lexical retrieval of documents by the questions of eval items; relevant are documents that name an item's rare words."""
    docs = lexical.postings(table(s, d, "documents"), "doc_id", "text")
    items = table(s, d, "eval_items").where("item_id is not null")
    terms = items.select(F.col("item_id").alias("q"), F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"), F.lit(1.0).alias("weight"))
    ranked = lexical.top(lexical.bm25(docs, terms), 10).select("q", "doc", "rank")
    rare = docs.groupBy("term").agg(F.count("*").alias("df")).where("df <= 5")
    gold = docs.join(rare, "term").join(terms, "term").select("q", "doc").distinct()
    return A.ranking_quality(ranked, gold, 10).withColumnRenamed("q", "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        profile_top_concepts, profile_top_files, profile_summary, important_titles, cochange_pairs, order_copurchase, error_repeat, rules, facet_match_all, facet_match_any, facet_stats, facet_dimensions,
        facet_values, majority_project, timeline_around, timeline_keyword, sliding_context, file_history_topk, replay_timeline, function_metrics, latency_percentiles, audit_topk, followup_rate,
        event_windows, event_sessions, session_counts, sessions_with_memories, commit_sessions, memory_page, retrieval_quality,
    )
}


def _top(values: str, name: str) -> str:
    return f"""SELECT project, value AS {name}, n FROM (
        SELECT project, value, count(*) AS n, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, value) AS r
        FROM (SELECT project, unnest({values}) AS value FROM memories WHERE project IS NOT NULL) WHERE value IS NOT NULL GROUP BY project, value) WHERE r <= 15"""


def _pairs(source: str, session: str, file: str, least: int) -> str:
    return f"""d AS (SELECT DISTINCT {session} AS s, {file} AS f FROM {source} WHERE {session} IS NOT NULL AND {file} IS NOT NULL),
        p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS frequency FROM d a JOIN d b ON a.s = b.s AND a.f < b.f GROUP BY ALL HAVING count(*) >= {least})"""


_FACETS = """f AS (SELECT DISTINCT p_partkey AS target_id, dimension, value FROM (
        SELECT p_partkey, 'p_brand' AS dimension, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part)
        WHERE value IS NOT NULL)"""
_EF = """f AS (SELECT DISTINCT event_id AS target_id, dimension, value FROM (
        SELECT event_id, 'kind' AS dimension, kind AS value FROM timeline_events UNION ALL SELECT event_id, 'tool_name', tool_name FROM timeline_events) WHERE value IS NOT NULL)"""
_FH = "(SELECT DISTINCT ON (obs_id) * FROM file_history WHERE obs_id IS NOT NULL)"
_SE = "(SELECT DISTINCT ON (session_id) * FROM sessions WHERE session_id IS NOT NULL)"

SQL = {
    "profile_top_concepts": _top("concepts", "concept"),
    "profile_top_files": _top("files", "file"),
    "profile_summary": f"SELECT project, count(*) AS sessions, sum(observation_count)::BIGINT AS observations, count(summary) AS summaries, max(started_at) AS last_started FROM {_SE} GROUP BY project",
    "important_titles": "SELECT session_id, arg_max(title, (importance, obs_id)) AS title, max(importance) AS importance FROM file_history WHERE importance >= 7 AND title IS NOT NULL GROUP BY session_id",
    "cochange_pairs": f"WITH {_pairs('file_history', 'session_id', 'file_path', 3)} SELECT * FROM p",
    "order_copurchase": f"WITH {_pairs('lineitem', 'l_orderkey', 'l_partkey', 3)} SELECT * FROM p",
    "error_repeat": f"SELECT lower(title) AS title, count(*) AS frequency FROM {_FH} WHERE title IS NOT NULL GROUP BY lower(title) HAVING count(*) >= 2",
    "rules": f"WITH {_pairs('file_history', 'session_id', 'file_path', 4)} SELECT format('When modifying {{}}, also check {{}} (changed together {{}} times)', file_a, file_b, frequency) AS rule FROM p",
    "facet_match_all": f"""WITH {_EF} SELECT target_id FROM f WHERE (dimension = 'kind' AND value = 'tool_call') OR (dimension = 'tool_name' AND value = 'Read') GROUP BY target_id HAVING count(*) = 2""",
    "facet_match_any": f"""WITH {_EF} SELECT target_id, count(*) AS n FROM f WHERE (dimension = 'kind' AND value = 'prompt') OR (dimension = 'tool_name' AND value = 'Read') GROUP BY target_id""",
    "facet_stats": f"WITH {_FACETS} SELECT dimension, value, count(*) AS n FROM f GROUP BY dimension, value",
    "facet_dimensions": f"WITH {_FACETS} SELECT dimension, count(*) AS n, count(DISTINCT value) AS n_values FROM f GROUP BY dimension",
    "facet_values": """SELECT memory_id AS target_id, dimension, string_agg(value, '|' ORDER BY value) AS values FROM (
        SELECT DISTINCT * FROM (SELECT memory_id, 'memory_type' AS dimension, memory_type AS value FROM memories UNION ALL SELECT memory_id, 'agent_id', agent_id FROM memories
        UNION ALL SELECT memory_id, 'project', project FROM memories) WHERE value IS NOT NULL) GROUP BY memory_id, dimension""",
    "majority_project": """WITH s AS (SELECT session_id, min(project) AS project FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id),
        l AS (SELECT memory_id, project FROM (SELECT memory_id, unnest(session_ids) AS session_id FROM memories) JOIN s USING (session_id) WHERE project IS NOT NULL),
        n AS (SELECT memory_id, project, count(*) AS n, (sum(count(*)) OVER (PARTITION BY memory_id))::BIGINT AS total, row_number() OVER (PARTITION BY memory_id ORDER BY count(*) DESC, project) AS r
              FROM l GROUP BY memory_id, project)
        SELECT memory_id, project, n, total FROM n WHERE r = 1 AND n * 2 > total""",
    "timeline_around": """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM (SELECT DISTINCT ON (event_id) event_id, ts, kind FROM timeline_events WHERE event_id IS NOT NULL) WHERE ts IS NOT NULL),
        m AS (SELECT pos AS mid FROM e ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2026-03-15 12:00:00')), pos LIMIT 1)
        SELECT (pos - mid)::INT AS relative, event_id, kind FROM e, m WHERE pos BETWEEN mid - 5 AND mid + 5""",
    "timeline_keyword": """SELECT memory_id, created_at FROM memories WHERE (coalesce(contains(lower(title), 'retry'), false) OR coalesce(contains(lower(content), 'retry'), false)
        OR len(list_filter(concepts, lambda c: contains(lower(c), 'retry'))) > 0) AND created_at IS NOT NULL ORDER BY created_at DESC, memory_id LIMIT 20""",
    "sliding_context": f"""SELECT obs_id, context FROM (SELECT obs_id, importance, array_to_string(list(coalesce(title, '-')) OVER (PARTITION BY session_id ORDER BY ts, obs_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), ' / ') AS context
        FROM {_FH}) WHERE importance >= 4""",
    "file_history_topk": f"""SELECT file_path, obs_id, importance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY importance DESC, ts DESC, obs_id) AS place
        FROM {_FH} WHERE file_path IS NOT NULL AND importance >= 4) WHERE place <= 5""",
    "replay_timeline": """
        WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY received_at NULLS FIRST, session_id NULLS FIRST, ts NULLS FIRST) AS r FROM raw_observations WHERE obs_id IS NOT NULL) WHERE r = 1),
        k AS (SELECT *, CASE WHEN hook_type IN ('session_start', 'session_end') THEN hook_type WHEN hook_type = 'prompt_submit' THEN 'prompt' WHEN hook_type = 'stop' AND length(assistant_response) > 0 THEN 'response'
                     WHEN hook_type = 'pre_tool_use' THEN 'tool_call' WHEN hook_type = 'post_tool_use' THEN 'tool_result' WHEN hook_type = 'post_tool_failure' THEN 'tool_error' ELSE 'hook' END AS kind,
                     min(ts) OVER (PARTITION BY session_id) AS t0 FROM o),
        c AS (SELECT *, CASE kind WHEN 'prompt' THEN coalesce(length(user_prompt), 0) WHEN 'response' THEN coalesce(length(assistant_response), 0) ELSE 0 END
                     + coalesce(length(tool_input), 0) + coalesce(length(tool_output), 0) AS chars FROM k)
        SELECT obs_id, kind, floor((epoch_us(ts) - epoch_us(t0)) / 1000.0)::BIGINT AS offset_ms, CASE WHEN chars = 0 THEN 300 ELSE greatest(300, least(20000, chars * 25)) END::BIGINT AS duration_ms FROM c WHERE session_id IS NOT NULL""",
    "function_metrics": "SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE value > 50) AS n_high, max(ts) AS last_ts FROM events GROUP BY event_type",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "audit_topk": "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 100",
    "followup_rate": """WITH e AS (SELECT user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 AND event_type <> lag(event_type) OVER w, false) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, count(*) AS searches, count(*) FILTER (WHERE f) AS followups, round(avg(f::INT), 6) AS rate FROM e GROUP BY user_id""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
        SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, g""",
    "session_counts": r"""WITH o AS (SELECT * FROM (SELECT obs_id, session_id, ts, user_prompt, row_number() OVER (PARTITION BY obs_id, session_id ORDER BY ts NULLS FIRST, user_prompt NULLS FIRST) AS r FROM raw_observations
          WHERE session_id IS NOT NULL AND obs_id IS NOT NULL) WHERE r = 1)
        SELECT session_id, count(*) AS n, arg_min(substring(trim(regexp_replace(user_prompt, '\s+', ' ', 'g')), 1, 200), (ts, obs_id)) FILTER (WHERE length(user_prompt) > 0) AS first_prompt, min(ts) AS first_ts, max(ts) AS last_ts
        FROM o GROUP BY session_id""",
    "sessions_with_memories": f"""SELECT session_id, status, count(memory_id) AS n_memories FROM {_SE} LEFT JOIN (SELECT DISTINCT memory_id, unnest(session_ids) AS session_id FROM memories) USING (session_id) GROUP BY session_id, status""",
    "commit_sessions": f"""SELECT sha, string_agg(DISTINCT session_id, '|' ORDER BY session_id) AS sessions, min(project) AS project FROM (SELECT unnest(commit_shas) AS sha, session_id, project FROM {_SE}) GROUP BY sha""",
    "memory_page": "SELECT memory_id, updated_at, agent_id FROM memories WHERE coalesce(is_latest, true) ORDER BY updated_at DESC NULLS LAST, memory_id LIMIT 50 OFFSET 20",
    "retrieval_quality": "WITH "
    + _DOC.replace(_SIMPLE, f"SELECT item_id AS q, unnest(list_distinct({_TOK.format('question')})) AS term, 1.0::DOUBLE AS weight FROM eval_items WHERE item_id IS NOT NULL")
    + """, r AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM score QUALIFY rank <= 10),
        rare AS (SELECT term FROM tf GROUP BY term HAVING count(*) <= 5), gold AS (SELECT DISTINCT q, doc FROM tf JOIN rare USING (term) JOIN qt USING (term)),
        ng AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q),
        x AS (SELECT r.q, count(*) AS n, count(g.doc) AS hits, sum(CASE WHEN g.doc IS NOT NULL THEN 1 / log2(rank + 1) END) AS dcg, min(CASE WHEN g.doc IS NOT NULL THEN rank END) AS first
              FROM r LEFT JOIN gold g ON r.q = g.q AND r.doc = g.doc GROUP BY r.q)
        SELECT ng.q AS item_id, round(coalesce(hits / n, 0), 6) AS precision, round(coalesce(hits / n_gold, 0), 6) AS recall,
               round(coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(n_gold, 10) + 1)]), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM ng LEFT JOIN x ON ng.q = x.q""",
}
