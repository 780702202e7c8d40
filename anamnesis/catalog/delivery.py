"""Queries of delivery and ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from anamnesis.plans.scratch import new_dir
from anamnesis.sources import archive, transcripts
from anamnesis.sources.tables import table
from anamnesis.streaming import exactly_once, ingest


def transcript_observations(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "transcript_rows").where("session_id is not null and uuid is not null").dropDuplicates(["session_id", "uuid"])
    return transcripts.observations(one).groupBy("session_id", "hook_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def stream_event_windows(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the event stream, taken in by a streaming query into files."""
    schema = table(s, d, "events").schema
    events = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return ingest.settled(ingest.windowed(events, "ts", ["event_type"]), ["started", "event_type"], new_dir(s, "event-windows"))


def memory_notes(s: SparkSession, d: str) -> DataFrame:
    return archive.markdown(table(s, d, "memories")).select("path", F.sha2("text", 256).alias("text_hash"))


def bridge_lines(s: SparkSession, d: str) -> DataFrame:
    """The strongest memories of each project that fill at most 40 lines."""
    m = table(s, d, "memories").where("project is not null and content is not null and strength is not null")
    return archive.line_budget(m, "project", "strength", "memory_id", "content", 40).select("project", "memory_id", "used_lines")


def import_merge(s: SparkSession, d: str) -> DataFrame:
    """Memories that an import of the even half would leave under each strategy."""
    m = table(s, d, "memories").select("memory_id", "version_no")
    half = m.where("pmod(version_no, 2) = 0").withColumn("version_no", F.col("version_no") + 100)
    out = None
    for how in ("merge", "skip", "replace"):
        one = archive.imported(m, half, "memory_id", how).agg(F.lit(how).alias("strategy"), F.count("*").alias("n"), F.sum("version_no").alias("versions"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_found": exactly_once.redelivered, "p7_kept": exactly_once.kept_once, "transcript_observations": transcript_observations, "stream_event_windows": stream_event_windows, "memory_notes": memory_notes, "bridge_lines": bridge_lines, "import_merge": import_merge}
SQL: dict[str, str] = {
    "p7_found": """
        SELECT 'raw_observations' AS table_name, min(session_id) AS session_id, obs_id AS record_id FROM raw_observations
        WHERE obs_id IS NOT NULL GROUP BY obs_id HAVING count(*) > 1
        UNION ALL
        SELECT 'transcript_rows', session_id, uuid FROM transcript_rows
        WHERE session_id IS NOT NULL AND uuid IS NOT NULL GROUP BY session_id, uuid HAVING count(*) > 1""",
    "p7_kept": """
        WITH o AS (SELECT *, coalesce(tool_name, '') || chr(1) || coalesce(tool_input, '') || chr(1) || coalesce(tool_output, '') || chr(1) || coalesce(user_prompt, '') || chr(1) || coalesce(assistant_response, '') AS payload,
                     row_number() OVER (PARTITION BY obs_id ORDER BY received_at NULLS FIRST, batch_id NULLS FIRST, session_id NULLS FIRST, tool_name NULLS FIRST, tool_input NULLS FIRST, tool_output NULLS FIRST,
                       user_prompt NULLS FIRST, assistant_response NULLS FIRST) AS r FROM raw_observations WHERE obs_id IS NOT NULL),
        t AS (SELECT *, coalesce(row_type, '') || chr(1) || coalesce(ts, '') || chr(1) || coalesce(message_role, '') AS payload,
                     row_number() OVER (PARTITION BY session_id, uuid ORDER BY received_at NULLS FIRST, batch_id NULLS FIRST, row_type NULLS FIRST, ts NULLS FIRST, message_role NULLS FIRST) AS r
              FROM transcript_rows WHERE session_id IS NOT NULL AND uuid IS NOT NULL)
        SELECT 'raw_observations' AS table_name, session_id, obs_id AS record_id, received_at, batch_id, payload FROM o WHERE r = 1
        UNION ALL SELECT 'transcript_rows', session_id, uuid, received_at, batch_id, payload FROM t WHERE r = 1""",
    "transcript_observations": """
        WITH o AS (SELECT DISTINCT ON (session_id, uuid) session_id, uuid, row_type, message_content FROM transcript_rows WHERE session_id IS NOT NULL AND uuid IS NOT NULL),
        b AS (SELECT session_id, row_type, unnest(message_content) AS b FROM o),
        h AS (SELECT session_id, CASE WHEN b.block_type = 'tool_result' AND coalesce(b.is_error, false) THEN 'post_tool_failure' WHEN b.block_type = 'tool_result' THEN 'post_tool_use'
                WHEN b.block_type = 'tool_use' THEN 'pre_tool_use' WHEN b.block_type = 'text' AND row_type = 'user' THEN 'prompt_submit' WHEN b.block_type = 'text' AND row_type = 'assistant' THEN 'stop' END AS hook_type,
                length(coalesce(b.text, b.tool_input, b.result_text)) AS n FROM b WHERE b.block_type <> 'text' OR regexp_matches(b.text, '\\S'))
        SELECT session_id, hook_type, count(*) AS n, sum(n)::BIGINT AS chars FROM h WHERE hook_type IS NOT NULL GROUP BY ALL""",
    "stream_event_windows": "SELECT date_trunc('hour', ts::TIMESTAMP) AS started, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "memory_notes": """SELECT 'memories/' || memory_id || '.md' AS path, sha256(concat_ws(chr(10), '---', 'id: ' || memory_id, 'type: ' || coalesce(memory_type, 'fact'), 'concepts: [' || array_to_string(coalesce(concepts, []), ', ') || ']',
        'files: [' || array_to_string(coalesce(files, []), ', ') || ']', '---') || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '') || chr(10)) AS text_hash
        FROM memories WHERE memory_id IS NOT NULL AND coalesce(is_latest, true)""",
    "bridge_lines": """WITH m AS (SELECT project, memory_id, (sum(length(content) - length(replace(content, chr(10), '')) + 1) OVER (PARTITION BY project ORDER BY strength DESC, memory_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used_lines
        FROM memories WHERE project IS NOT NULL AND content IS NOT NULL AND strength IS NOT NULL) SELECT * FROM m WHERE used_lines <= 40""",
    "import_merge": """WITH h AS (SELECT memory_id, version_no + 100 AS version_no FROM memories WHERE version_no % 2 = 0)
        SELECT 'merge' AS strategy, count(*) AS n, sum(v)::BIGINT AS versions FROM (SELECT version_no AS v FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM h) UNION ALL SELECT version_no FROM h)
        UNION ALL SELECT 'skip', count(*), sum(version_no)::BIGINT FROM memories UNION ALL SELECT 'replace', count(*), sum(version_no)::BIGINT FROM h""",
}
