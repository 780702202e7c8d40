"""The package's queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm import conversations, credentials, knn, leakage, neardup, packing, runs, spam, truncation
from anamnesis.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 4, one row for each stored row."""
    part = lambda name, field, key: table(spark, d, name).select(F.lit(field).alias("field_name"), F.col(key).alias("id"), F.col(field).alias("text"))
    return part("memories", "content", "memory_id").unionByName(part("file_history", "narrative", "obs_id")).unionByName(part("sessions", "summary", "session_id"))


def _authored(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 1; an event's source is the agent of its session."""
    obs, events = table(spark, d, "raw_observations"), table(spark, d, "timeline_events")
    agents = table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min("agent_id").alias("agent_id"))
    events = events.select("event_id", "session_id", "body").where("body is not null").join(agents, "session_id", "left")
    agent = F.col("agent_id")
    return truncation.values([(obs, "obs_id", "user_prompt", agent), (obs, "obs_id", "assistant_response", agent), (events, "event_id", "body", agent)])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut(_authored(spark, d))


def p1_by_agent(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(_authored(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(table(spark, d, "raw_observations"))


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    return credentials.scanned(table(spark, d, "raw_observations")).select("obs_id", "field_name", "n_secrets", "masked").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    named = lambda n, df: df.select(F.lit(n).alias("table_name"), "key_a", "key_b")
    images = knn.pairs(table(spark, d, "image_vectors"), "image_ref", "vector", 64)
    sessions = knn.pairs(table(spark, d, "session_vectors"), "session_id", "embedding", 96)
    return named("image_vectors", images).unionByName(named("session_vectors", sessions))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbours(table(spark, d, "embeddings").withColumn("name", F.format_string("%012d", "vec_id")), "name", "embedding", 64)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_records(_texts(spark, d), 0.7)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_texts(spark, d), 0.7)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.token_counts(table(spark, d, "documents")), table(spark, d, "context_windows"))


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(packing.token_counts(table(spark, d, "documents")), table(spark, d, "context_windows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.left_out(table(spark, d, "transcript_rows"))


def p5_threads(spark: SparkSession, d: str) -> DataFrame:
    return conversations.linked(table(spark, d, "transcript_rows"))


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.usability(table(spark, d, "transcript_rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated(table(spark, d, "timeline_events"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapsed(table(spark, d, "timeline_events"), *runs.LENIENT)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.flagged(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return spam.scored(table(spark, d, "documents")).select("doc_id", "n_words", r("listed"), r("natural"), r("repeats"), r("stuffed"), r("shared"), r("prose"), "spam")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_by_agent": p1_by_agent, "p2_found": p2_found, "p2_masked": p2_masked, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_threads": p5_threads, "p5_sessions": p5_sessions, "p6_found": p6_found, "p6_collapsed": p6_collapsed, "p8_packed": p8_packed, "p8_bounds": p8_bounds, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_scores": p10_scores}
SQL: dict[str, str] = {
    "p6_found": """
        WITH e AS (
          SELECT event_id, min(session_id) AS session_id, min(ts) AS ts, min(kind) AS kind,
                 coalesce(min(regexp_replace(lower(tool_name), '[^\\p{L}\\p{N}]+', '', 'g')), '') AS tool
          FROM timeline_events WHERE event_id IS NOT NULL AND session_id IS NOT NULL GROUP BY event_id),
        n AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND kind IS NOT DISTINCT FROM lag(kind) OVER w AND tool = lag(tool) OVER w THEN 0 ELSE 1 END AS new
              FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, event_id)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS g FROM n)
        SELECT session_id, arg_min(event_id, (coalesce(ts, TIMESTAMP '0001-01-01'), event_id)) AS first_event_id,
               arg_max(event_id, (coalesce(ts, TIMESTAMP '0001-01-01'), event_id)) AS last_event_id
        FROM g GROUP BY session_id, g HAVING count(*) > 1""",
    "p4_found": r"""
        WITH r AS (SELECT 'content' AS field_name, memory_id AS id, content AS text FROM memories UNION ALL SELECT 'narrative', obs_id, narrative FROM file_history UNION ALL SELECT 'summary', session_id, summary FROM sessions),
        w AS (SELECT field_name, id, list_distinct(regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+')) AS w FROM r WHERE id IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]') GROUP BY field_name, id),
        t AS (SELECT field_name, id, len(w) AS n, unnest(w) AS word FROM w),
        p AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
              FROM t a JOIN t b ON a.field_name = b.field_name AND a.word = b.word AND a.id < b.id AND a.n >= 0.699 * b.n AND b.n >= 0.699 * a.n GROUP BY ALL)
        SELECT field_name, id_a, id_b FROM p WHERE common * 10 >= 7 * (na + nb - common)""",
    "p4_groups": r"""
        WITH r AS (SELECT 'content' AS field_name, memory_id AS id, content AS text FROM memories UNION ALL SELECT 'narrative', obs_id, narrative FROM file_history UNION ALL SELECT 'summary', session_id, summary FROM sessions),
        w AS (SELECT field_name, id, list_sort(list_distinct(regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+'))) AS w FROM r WHERE id IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]') GROUP BY field_name, id),
        c AS (SELECT field_name, w, min(id) AS class_id FROM w GROUP BY ALL),
        t AS (SELECT field_name, class_id, len(w) AS n, unnest(w) AS word FROM c),
        p AS (SELECT a.field_name, a.class_id, b.class_id AS other, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
              FROM t a JOIN t b ON a.field_name = b.field_name AND a.word = b.word AND a.class_id <> b.class_id AND a.n >= 0.699 * b.n AND b.n >= 0.699 * a.n GROUP BY ALL),
        l AS (SELECT field_name, class_id, count(*) AS links FROM p WHERE common * 10 >= 7 * (na + nb - common) GROUP BY ALL)
        SELECT w.field_name, w.id, c.class_id, coalesce(l.links, 0) AS links FROM w JOIN c USING (field_name, w) LEFT JOIN l USING (field_name, class_id)""",
    "p5_found": r"""
        WITH o AS (SELECT DISTINCT ON (session_id, uuid) session_id, uuid, trim(ts) AS ts, lower(trim(message_role)) AS role, coalesce(message_content, []) AS c
                   FROM transcript_rows WHERE session_id IS NOT NULL AND uuid IS NOT NULL ORDER BY session_id, uuid, received_at, batch_id),
        m AS (SELECT session_id, uuid,
                CASE WHEN regexp_full_match(ts, '\d+') THEN TRY_CAST(ts AS BIGINT) * 1000
                     ELSE epoch_us(TRY_CAST(CASE WHEN regexp_matches(ts, '(Z|[+-]\d{2}:\d{2})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) END AS t,
                CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'ai', 'model') THEN 'assistant' WHEN role = 'system' THEN 'system' END AS role,
                len(list_filter(c, lambda b: b.block_type = 'text' AND regexp_matches(b.text, '[^\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]'))) > 0 AS text,
                list_transform(list_filter(c, lambda b: b.block_type = 'tool_use'), lambda b: b.tool_use_id) AS uses,
                list_transform(list_filter(c, lambda b: b.block_type = 'tool_result'), lambda b: b.tool_use_id) AS results FROM o),
        bad AS (SELECT session_id FROM m WHERE role IS NULL OR t IS NULL),
        odd AS (SELECT session_id FROM (SELECT session_id, unnest(uses) AS id, 1 AS k FROM m UNION SELECT session_id, unnest(results), 2 FROM m) GROUP BY session_id, id HAVING sum(k) < 3),
        q AS (SELECT *, role = 'user' AND text AS u, role = 'assistant' AND text AS a, row_number() OVER (PARTITION BY session_id ORDER BY t, uuid) AS n
              FROM m WHERE role <> 'system' AND (text OR len(uses) + len(results) > 0)),
        f AS (SELECT session_id FROM q WHERE n = 1 AND NOT u),
        x AS (SELECT session_id, u, lead(a) OVER (PARTITION BY session_id ORDER BY n) AS answered FROM q WHERE u OR a)
        SELECT DISTINCT session_id FROM m WHERE session_id IN (SELECT session_id FROM bad) OR session_id IN (SELECT session_id FROM odd) OR session_id IN (SELECT session_id FROM f)
          OR session_id NOT IN (SELECT session_id FROM q) OR session_id IN (SELECT session_id FROM x WHERE u AND NOT coalesce(answered, false))""",
    "p5_sessions": r"""
        WITH o AS (SELECT DISTINCT ON (session_id, uuid) session_id, uuid, trim(ts) AS ts, lower(trim(message_role)) AS role, coalesce(message_content, []) AS c
                   FROM transcript_rows WHERE session_id IS NOT NULL AND uuid IS NOT NULL ORDER BY session_id, uuid, received_at, batch_id),
        m AS (SELECT session_id, uuid,
                CASE WHEN regexp_full_match(ts, '\d+') THEN TRY_CAST(ts AS BIGINT) * 1000
                     ELSE epoch_us(TRY_CAST(CASE WHEN regexp_matches(ts, '(Z|[+-]\d{2}:\d{2})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) END AS t,
                CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'ai', 'model') THEN 'assistant' WHEN role = 'system' THEN 'system' END AS role,
                len(list_filter(c, lambda b: b.block_type = 'text' AND regexp_matches(b.text, '[^\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]'))) > 0 AS text,
                list_transform(list_filter(c, lambda b: b.block_type = 'tool_use'), lambda b: b.tool_use_id) AS uses,
                list_transform(list_filter(c, lambda b: b.block_type = 'tool_result'), lambda b: b.tool_use_id) AS results FROM o),
        bad AS (SELECT session_id FROM m WHERE role IS NULL OR t IS NULL),
        odd AS (SELECT session_id FROM (SELECT session_id, unnest(uses) AS id, 1 AS k FROM m UNION SELECT session_id, unnest(results), 2 FROM m) GROUP BY session_id, id HAVING sum(k) < 3),
        q AS (SELECT *, role = 'user' AND text AS u, role = 'assistant' AND text AS a, row_number() OVER (PARTITION BY session_id ORDER BY t, uuid) AS n
              FROM m WHERE role <> 'system' AND (text OR len(uses) + len(results) > 0)),
        f AS (SELECT session_id FROM q WHERE n = 1 AND NOT u),
        x AS (SELECT session_id, u, lead(a) OVER (PARTITION BY session_id ORDER BY n) AS answered FROM q WHERE u OR a)
        SELECT session_id, bool_or(m.role IS NULL OR m.t IS NULL) AS bad_row, session_id IN (SELECT session_id FROM odd) AS bad_tools,
               session_id IN (SELECT session_id FROM f) OR session_id NOT IN (SELECT session_id FROM q) OR session_id IN (SELECT session_id FROM x WHERE u AND NOT coalesce(answered, false)) AS bad_order,
               count(*) AS n_rows, NOT (bool_or(m.role IS NULL OR m.t IS NULL) OR session_id IN (SELECT session_id FROM odd) OR session_id IN (SELECT session_id FROM f) OR session_id NOT IN (SELECT session_id FROM q)
                 OR session_id IN (SELECT session_id FROM x WHERE u AND NOT coalesce(answered, false))) AS usable
        FROM m GROUP BY session_id""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        e AS (SELECT item_id, regexp_extract_all(lower(p), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, question AS p FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items) WHERE item_id IS NOT NULL AND p IS NOT NULL),
        ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (x)""",
    "p9_items": r"""
        WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        dw AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        e AS (SELECT item_id, regexp_extract_all(lower(p), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, question AS p FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items) WHERE item_id IS NOT NULL AND p IS NOT NULL),
        ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
        h AS (SELECT doc_id, item_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 OR lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM dw JOIN ew USING (x)),
        g AS (SELECT doc_id, item_id, i, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS g FROM h),
        s AS (SELECT doc_id, item_id, max(i) - min(i) + 12 AS n FROM g GROUP BY doc_id, item_id, g),
        t AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_spans, max(n) AS longest FROM s GROUP BY item_id)
        SELECT DISTINCT i.item_id, i.item_type, coalesce(n_docs, 0) AS n_docs, coalesce(n_spans, 0) AS n_spans, coalesce(longest, 0) AS longest FROM eval_items i LEFT JOIN t USING (item_id)""",
}
