"""Queries of point access, partial writes, deletes, slots, governance, exchange between stores, lists and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import lifecycle as L
from anamnesis.operators import work as W
from anamnesis.sources.tables import table

AS_OF = "2026-07-01 00:00:00"


def _memories(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories").where("memory_id is not null")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    """One row a session, the smallest of repeated ones."""
    c = ["project", "cwd", "started_at", "ended_at", "status", "summary", "agent_id"]
    return table(s, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min(F.struct(*c)).alias("x")).select("session_id", "x.*")


def row_lookup(s: SparkSession, d: str) -> DataFrame:
    """The memory of one id; the filter reaches the scan."""
    m = _memories(s, d)
    one = m.agg(F.min("memory_id").alias("memory_id"))
    return m.join(F.broadcast(one), "memory_id").select("memory_id", "title", "version_no")


def rows_updated(s: SparkSession, d: str) -> DataFrame:
    """Partial update: cited memories become stronger by one, all else stays."""
    m = _memories(s, d).select("memory_id", "strength", "version_no", "memory_type")
    p = m.where("version_no > 1").select("memory_id", (F.col("strength") + 1).alias("strength"), F.lit(None).cast("string").alias("memory_type"))
    return W.updated(m, p, "memory_id", ["strength", "memory_type"]).select("memory_id", F.round("strength", 6).alias("strength"), "memory_type")


def rows_upserted(s: SparkSession, d: str) -> DataFrame:
    """Upsert by key: newer rows replace those of their key, others are added."""
    m = _memories(s, d).select("memory_id", "version_no")
    new = m.where("version_no > 1").select("memory_id", (F.col("version_no") + 10).alias("version_no")).unionByName(m.where("version_no > 1").select(F.concat("memory_id", F.lit("-new")).alias("memory_id"), F.lit(1).alias("version_no")))
    return m.join(new.select("memory_id"), "memory_id", "left_anti").unionByName(new)


def memory_forgotten(s: SparkSession, d: str) -> DataFrame:
    """Observations left after whole sessions are forgotten, and memories left after those that cite only them."""
    o, se = table(s, d, "raw_observations").where("obs_id is not null"), _sessions(s, d)
    gone = se.where("status = 'abandoned' or ended_at is null").select("session_id")
    left = o.join(gone, "session_id", "left_anti").select("obs_id").distinct()
    m = _memories(s, d)
    cited = m.select("memory_id", F.explode_outer("session_ids").alias("session_id")).join(gone.withColumn("gone", F.lit(1)), "session_id", "left")
    keep = cited.groupBy("memory_id").agg(F.bool_or(F.col("gone").isNull()).alias("keep")).where("keep")
    return left.agg(F.lit("observations").alias("what"), F.count("*").alias("n")).unionByName(keep.agg(F.lit("memories").alias("what"), F.count("*").alias("n")))


def governance_bulk(s: SparkSession, d: str) -> DataFrame:
    """A dry run: what a delete by kind, age and quality would take, by kind."""
    old = F.col("updated_at") < F.lit("2026-03-01").cast("timestamp")
    return _memories(s, d).where(F.col("memory_type").isin("fact", "bug", "pattern") & old & (F.col("strength") < 6)).groupBy("memory_type").agg(F.count("*").alias("n"))


def governance_delete(s: SparkSession, d: str) -> DataFrame:
    """What stays when the weakest ten and their uses are deleted, with one row for the audit."""
    m = _memories(s, d).where("strength is not null")
    gone = m.orderBy("strength", "memory_id").limit(10).select("memory_id")
    uses = m.select("memory_id", F.explode("source_observation_ids").alias("o"))
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [n("memories", m.join(gone, "memory_id", "left_anti")), n("uses", uses.join(gone, "memory_id", "left_anti")), n("deleted", gone)])


def peer_delta(s: SparkSession, d: str) -> DataFrame:
    """What another store has not seen: changed after a time, of two projects."""
    m = _memories(s, d).where((F.col("updated_at") > F.lit("2026-02-01").cast("timestamp")) & F.col("project").isNotNull())
    return m.where(F.substring("project", 6, 1).isin("a", "b", "c")).select("memory_id", "updated_at")


def peer_received(s: SparkSession, d: str) -> DataFrame:
    """A peer's rows merged in: the strictly later time wins, unknown rows are added."""
    m = _memories(s, d).where("updated_at is not null").select("memory_id", "updated_at", "version_no")
    theirs = m.where("version_no > 1").select("memory_id", F.when(F.col("version_no") % 2 == 0, F.col("updated_at") + F.expr("interval 1 day")).otherwise(F.col("updated_at")).alias("updated_at"), (F.col("version_no") + 100).alias("version_no"))
    return L.last_writer_wins(m, theirs, "memory_id", "updated_at").select("memory_id", "version_no")


def _slots(s: SparkSession, d: str, project: str | None) -> DataFrame:
    """The newest memory of a kind as a slot of that label."""
    m = _memories(s, d).where("memory_type is not null and content is not null and updated_at is not null")
    m = m.where("project is null") if project is None else m.where(F.col("project") == project)
    return m.groupBy(F.col("memory_type").alias("label")).agg(F.max_by(F.struct("content", "memory_id"), F.struct("updated_at", "memory_id")).alias("x")).select("label", "x.content", "x.memory_id")


def slot_list(s: SparkSession, d: str) -> DataFrame:
    """Slots of a project before the general ones, by label."""
    return W.overrides(_slots(s, d, "proj-amber-lease"), _slots(s, d, None), "label", "memory_id").orderBy("label")


def slot_appended(s: SparkSession, d: str) -> DataFrame:
    """A line appended to each general slot, where the limit of 400 characters allows it."""
    new = F.concat_ws("\n", F.when(F.length("content") > 0, F.col("content")), F.lit("checked again"))
    fits = F.length(new) <= 400
    return _slots(s, d, None).select("label", F.length(F.when(fits, new).otherwise(F.col("content"))).alias("n_chars"), fits.alias("done"))


def slot_reflected(s: SparkSession, d: str) -> DataFrame:
    """Of the last fifty observations of a session: lines that say what is to do, errors, commands, and distinct files."""
    f = table(s, d, "file_history").where("obs_id is not null and session_id is not null and ts is not null")
    f = f.groupBy("obs_id").agg(F.min(F.struct("session_id", "ts", "obs_type", "file_path", "narrative")).alias("x")).select("obs_id", "x.*")
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("obs_id"))
    f = f.withColumn("r", F.row_number().over(w)).where("r <= 50")
    text = F.lower(F.coalesce("narrative", F.lit("")))
    return f.groupBy("session_id").agg(
        F.count_if(text.rlike("todo|fixme|please|should")).alias("to_do"), F.count_if((F.col("obs_type") == "error") | text.contains("fail")).alias("errors"),
        F.count_if(F.col("obs_type") == "command_run").alias("commands"), F.count_distinct("file_path").alias("files"),
    )


def lesson_list(s: SparkSession, d: str) -> DataFrame:
    m = _memories(s, d).where("coalesce(is_latest, true) and strength >= 1 and project = 'proj-amber-lease'")
    return m.orderBy(F.desc("strength"), "memory_id").limit(50).select("memory_id", "strength")


def lesson_preview(s: SparkSession, d: str) -> DataFrame:
    """Contents of lessons, cut to 240 characters with an ellipsis."""
    return _memories(s, d).where("content is not null").select("memory_id", F.sha2(T.shortened(F.col("content"), 240), 256).alias("preview"))


def lesson_deleted(s: SparkSession, d: str) -> DataFrame:
    """A soft delete of the expired ones: marked, not removed."""
    m = _memories(s, d)
    gone = F.coalesce(F.col("forget_after") < F.lit(AS_OF).cast("timestamp"), F.lit(False))
    return m.groupBy(gone.alias("deleted")).agg(F.count("*").alias("n"), F.sum("version_no").cast("long").alias("versions"))


def insight_list(s: SparkSession, d: str) -> DataFrame:
    """Confidence times recency, the best fifty."""
    days = L.days_since(F.col("updated_at"), AS_OF)
    m = _memories(s, d).where("strength is not null and updated_at is not null")
    return m.select("memory_id", F.round(F.col("strength") / 10 / (1 + 0.01 * days), 6).alias("score")).orderBy(F.desc("score"), "memory_id").limit(50)


def image_references(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "image_vectors").where("image_ref is not null").groupBy("image_ref").agg(F.count("*").alias("n"), F.count_distinct("observation_id").alias("observations"))


def image_quota(s: SparkSession, d: str) -> DataFrame:
    """Images to be removed, oldest first, until what stays is within a budget of numbers for each model."""
    i = table(s, d, "image_vectors").where("image_ref is not null and vector is not null and updated_at is not null").groupBy("image_ref").agg(F.min(F.struct("model_name", "updated_at", F.size("vector").cast("long").alias("size"))).alias("x")).select("image_ref", "x.*")
    return W.paged_out(i, "model_name", [F.col("updated_at"), F.col("image_ref")], "size", F.lit(10_000)).select("image_ref", "model_name")


def working_context(s: SparkSession, d: str) -> DataFrame:
    """Memories of a project that fill a budget of tokens, the strongest and newest first."""
    m = _memories(s, d).where("content is not null and project is not null and strength is not null").select("project", "memory_id", "strength", "updated_at", T.estimated_tokens(F.col("content")).cast("long").alias("tokens"))
    w = Window.partitionBy("project").orderBy(F.desc("strength"), F.desc_nulls_last("updated_at"), "memory_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("used", F.sum("tokens").over(w)).where("used <= 2000").select("project", "memory_id", "used")


def core_paged(s: SparkSession, d: str) -> DataFrame:
    """What leaves the core of each project, the weakest first, until 600 tokens are kept."""
    m = _memories(s, d).where("content is not null and project is not null and strength is not null").select("project", "memory_id", "strength", T.estimated_tokens(F.col("content")).cast("long").alias("tokens"))
    return W.paged_out(m, "project", [F.col("strength"), F.col("memory_id")], "tokens", F.lit(600)).groupBy("project").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def core_list(s: SparkSession, d: str) -> DataFrame:
    m = _memories(s, d).where("content is not null and strength is not null").select("memory_id", F.greatest(F.lit(1), F.least(F.lit(10), F.round("strength").cast("int"))).alias("importance"), T.estimated_tokens(F.col("content")).cast("long").alias("tokens"))
    return m.groupBy("importance").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def branch_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions in a folder or below it, newest first."""
    se = _sessions(s, d)
    root = se.agg(F.min("cwd").alias("root"))
    at = F.col("cwd").eqNullSafe(F.col("root")) | F.col("cwd").startswith(F.concat("root", F.lit("/"))) | (F.col("project") == "proj-amber-lease")
    return se.join(F.broadcast(root), at).select("session_id", "cwd")


def session_observations(s: SparkSession, d: str) -> DataFrame:
    """Observations of an agent in the sessions of a project."""
    se = _sessions(s, d).where("project = 'proj-amber-lease'").select("session_id")
    o = table(s, d, "raw_observations").where("obs_id is not null").join(se, "session_id", "left_semi")
    return o.groupBy("session_id", "agent_id").agg(F.count_distinct("obs_id").alias("n"))


def session_changes(s: SparkSession, d: str) -> DataFrame:
    """Sessions that were added or got another count between two states: those begun before a day, and all."""
    se = table(s, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("observation_count").alias("n"))
    early = se.where("started_at < timestamp'2026-01-15'").withColumn("n", F.when(F.col("n") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return W.changes(early, se, "session_id", ["n"]).groupBy("change").agg(F.count("*").alias("n"))


def store_status(s: SparkSession, d: str) -> DataFrame:
    """Counts of the store's parts."""
    m, se, o = _memories(s, d), _sessions(s, d), table(s, d, "raw_observations").where("obs_id is not null")
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    parts = [n("sessions", se), n("observations", o.select("obs_id").distinct()), n("memories", m), n("latest memories", m.where("is_latest")), n("open sessions", se.where("ended_at is null"))]
    return reduce(DataFrame.unionByName, parts)


def recent_summaries(s: SparkSession, d: str) -> DataFrame:
    """The five newest summaries of each project."""
    w = Window.partitionBy("project").orderBy(F.desc("started_at"), "session_id")
    se = _sessions(s, d).where("coalesce(trim(summary), '') <> '' and project is not null and started_at is not null")
    return se.withColumn("place", F.row_number().over(w)).where("place <= 5").select("project", "session_id", "place")


def latest_memories(s: SparkSession, d: str) -> DataFrame:
    return _memories(s, d).where("is_latest and updated_at is not null").orderBy(F.desc("updated_at"), "memory_id").limit(10).select("memory_id", "updated_at")


def team_profile(s: SparkSession, d: str) -> DataFrame:
    """What the agents of a team share: memories, mean strength, and kinds, by agent."""
    m = _memories(s, d).where("agent_id is not null")
    return m.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("strength"), F.count_distinct("memory_type").alias("kinds"), F.count_distinct("project").alias("projects"))


def team_feed(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), "memory_id")
    m = _memories(s, d).where("project is not null and agent_id is not null and created_at is not null and coalesce(is_latest, true)")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 20").select("project", "memory_id", "agent_id", "place")


def health(s: SparkSession, d: str) -> DataFrame:
    """Error shares per day against fixed thresholds: a warning from a tenth on, critical from a quarter on."""
    e = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    share = F.col("errors") / F.col("n")
    return e.select("day", "n", "errors", F.when(share >= 0.25, "critical").when(share >= 0.1, "warning").otherwise("healthy").alias("state"))


def healed(s: SparkSession, d: str) -> DataFrame:
    """Repairs: several latest rows under one parent leave the newest, and expired ones stop being the latest."""
    m = _memories(s, d).where("is_latest")
    w = Window.partitionBy(F.coalesce("parent_id", "memory_id")).orderBy(F.desc_nulls_last("version_no"), F.desc_nulls_last("updated_at"), "memory_id")
    m = m.withColumn("r", F.row_number().over(w))
    fix = F.when(F.col("r") > 1, "superseded").when(F.col("forget_after") < F.lit(AS_OF).cast("timestamp"), "expired")
    return m.select("memory_id", fix.alias("repair")).where("repair is not null")


QUERIES = {
    f.__name__: f
    for f in (
        row_lookup, rows_updated, rows_upserted, memory_forgotten, governance_bulk, governance_delete, peer_delta, peer_received, slot_list, slot_appended, slot_reflected, lesson_list, lesson_preview,
        lesson_deleted, insight_list, image_references, image_quota, working_context, core_paged, core_list, branch_sessions, session_observations, session_changes, store_status, recent_summaries,
        latest_memories, team_profile, team_feed, health, healed,
    )
}

_M = "m AS (SELECT * FROM memories WHERE memory_id IS NOT NULL)"
_SE = """se AS (SELECT session_id, x.project AS project, x.cwd AS cwd, x.started_at AS started_at, x.ended_at AS ended_at, x.status AS status, x.summary AS summary FROM (
          SELECT session_id, list_sort(list({'project': project, 'cwd': cwd, 'started_at': started_at, 'ended_at': ended_at, 'status': status, 'summary': summary, 'agent_id': agent_id}), 'ASC', 'NULLS FIRST')[1] AS x
          FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id))"""
_GEN = """g AS (SELECT memory_type AS label, arg_max(content, {'u': updated_at, 'm': memory_id}) AS content, arg_max(memory_id, {'u': updated_at, 'm': memory_id}) AS memory_id
          FROM m WHERE memory_type IS NOT NULL AND content IS NOT NULL AND updated_at IS NOT NULL AND project IS NULL GROUP BY memory_type)"""

SQL = {
    "row_lookup": "SELECT memory_id, title, version_no FROM memories WHERE memory_id = (SELECT min(memory_id) FROM memories)",
    "rows_updated": f"WITH {_M} SELECT memory_id, round(CASE WHEN version_no > 1 AND strength IS NOT NULL THEN strength + 1 ELSE strength END, 6) AS strength, memory_type FROM m",
    "rows_upserted": f"WITH {_M} SELECT memory_id, CASE WHEN version_no > 1 THEN version_no + 10 ELSE version_no END AS version_no FROM m UNION ALL SELECT memory_id || '-new', 1 FROM m WHERE version_no > 1",
    "memory_forgotten": f"""WITH {_M}, {_SE}, gone AS (SELECT session_id FROM se WHERE status = 'abandoned' OR ended_at IS NULL),
        c AS (SELECT memory_id, unnest(CASE WHEN len(session_ids) > 0 THEN session_ids ELSE [NULL] END) AS session_id FROM m)
        SELECT 'observations' AS what, count(DISTINCT obs_id) AS n FROM raw_observations WHERE obs_id IS NOT NULL AND (session_id IS NULL OR session_id NOT IN (SELECT session_id FROM gone))
        UNION ALL SELECT 'memories', count(*) FROM (SELECT memory_id FROM c GROUP BY memory_id HAVING bool_or(session_id IS NULL OR session_id NOT IN (SELECT session_id FROM gone)))""",
    "governance_bulk": f"WITH {_M} SELECT memory_type, count(*) AS n FROM m WHERE memory_type IN ('fact', 'bug', 'pattern') AND updated_at < TIMESTAMP '2026-03-01' AND strength < 6 GROUP BY memory_type",
    "governance_delete": f"""WITH {_M}, x AS (SELECT * FROM m WHERE strength IS NOT NULL), g AS (SELECT memory_id FROM x ORDER BY strength, memory_id LIMIT 10)
        SELECT 'memories' AS what, count(*) AS n FROM x WHERE memory_id NOT IN (SELECT memory_id FROM g)
        UNION ALL SELECT 'uses', count(*) FROM (SELECT memory_id, unnest(source_observation_ids) FROM x) WHERE memory_id NOT IN (SELECT memory_id FROM g) UNION ALL SELECT 'deleted', count(*) FROM g""",
    "peer_delta": f"WITH {_M} SELECT memory_id, updated_at FROM m WHERE updated_at > TIMESTAMP '2026-02-01' AND substr(project, 6, 1) IN ('a', 'b', 'c')",
    "peer_received": f"WITH {_M} SELECT memory_id, CASE WHEN version_no > 1 AND version_no % 2 = 0 THEN version_no + 100 ELSE version_no END AS version_no FROM m WHERE updated_at IS NOT NULL",
    "slot_list": f"""WITH {_M}, {_GEN}, p AS (SELECT memory_type AS label, arg_max(memory_id, {{'u': updated_at, 'm': memory_id}}) AS memory_id FROM m
          WHERE memory_type IS NOT NULL AND content IS NOT NULL AND updated_at IS NOT NULL AND project = 'proj-amber-lease' GROUP BY memory_type)
        SELECT coalesce(p.label, g.label) AS label, coalesce(p.memory_id, g.memory_id) AS memory_id, p.label IS NOT NULL AS special FROM p FULL JOIN g ON p.label = g.label""",
    "slot_appended": f"""WITH {_M}, {_GEN}, n AS (SELECT label, content, CASE WHEN length(content) > 0 THEN content || chr(10) || 'checked again' ELSE 'checked again' END AS new FROM g)
        SELECT label, length(CASE WHEN length(new) <= 400 THEN new ELSE content END)::INT AS n_chars, length(new) <= 400 AS done FROM n""",
    "slot_reflected": """WITH o AS (SELECT obs_id, list_sort(list({'session_id': session_id, 'ts': ts, 'obs_type': obs_type, 'file_path': file_path, 'narrative': narrative}), 'ASC', 'NULLS FIRST')[1] AS x
          FROM file_history WHERE obs_id IS NOT NULL AND session_id IS NOT NULL AND ts IS NOT NULL GROUP BY obs_id),
        f AS (SELECT obs_id, x.session_id AS session_id, x.obs_type AS obs_type, x.file_path AS file_path, lower(coalesce(x.narrative, '')) AS t FROM o QUALIFY row_number() OVER (PARTITION BY x.session_id ORDER BY x.ts DESC, obs_id DESC) <= 50)
        SELECT session_id, count(*) FILTER (WHERE regexp_matches(t, 'todo|fixme|please|should')) AS to_do, count(*) FILTER (WHERE obs_type = 'error' OR contains(t, 'fail')) AS errors,
               count(*) FILTER (WHERE obs_type = 'command_run') AS commands, count(DISTINCT file_path) AS files FROM f GROUP BY session_id""",
    "lesson_list": f"WITH {_M} SELECT memory_id, strength FROM m WHERE coalesce(is_latest, true) AND strength >= 1 AND project = 'proj-amber-lease' ORDER BY strength DESC, memory_id LIMIT 50",
    "lesson_preview": f"WITH {_M} SELECT memory_id, sha256(CASE WHEN length(content) > 240 THEN substr(content, 1, 239) || '…' ELSE content END) AS preview FROM m WHERE content IS NOT NULL",
    "lesson_deleted": f"WITH {_M} SELECT coalesce(forget_after < TIMESTAMP '2026-07-01', false) AS deleted, count(*) AS n, sum(version_no)::BIGINT AS versions FROM m GROUP BY 1",
    "insight_list": f"""WITH {_M} SELECT memory_id, round(strength / 10 / (1 + 0.01 * (epoch_us(TIMESTAMP '2026-07-01') - epoch_us(updated_at)) / 86400e6), 6) AS score FROM m
        WHERE strength IS NOT NULL AND updated_at IS NOT NULL ORDER BY score DESC, memory_id LIMIT 50""",
    "image_references": "SELECT image_ref, count(*) AS n, count(DISTINCT observation_id) AS observations FROM image_vectors WHERE image_ref IS NOT NULL GROUP BY image_ref",
    "image_quota": """WITH o AS (SELECT image_ref, list_sort(list({'model_name': model_name, 'updated_at': updated_at, 'size': len(vector)}), 'ASC', 'NULLS FIRST')[1] AS x
          FROM image_vectors WHERE image_ref IS NOT NULL AND vector IS NOT NULL AND updated_at IS NOT NULL GROUP BY image_ref),
        i AS (SELECT image_ref, x.model_name AS model_name, sum(x.size) OVER (PARTITION BY x.model_name ORDER BY x.updated_at DESC, image_ref DESC ROWS UNBOUNDED PRECEDING) AS stays FROM o)
        SELECT image_ref, model_name FROM i WHERE stays > 10000""",
    "working_context": f"""WITH {_M} SELECT project, memory_id, (sum(ceil(length(content) / 3.0)::BIGINT) OVER (PARTITION BY project ORDER BY strength DESC, updated_at DESC NULLS LAST, memory_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used
        FROM m WHERE content IS NOT NULL AND project IS NOT NULL AND strength IS NOT NULL QUALIFY used <= 2000""",
    "core_paged": f"""WITH {_M}, t AS (SELECT project, ceil(length(content) / 3.0)::BIGINT AS tokens, sum(ceil(length(content) / 3.0)::BIGINT) OVER (PARTITION BY project ORDER BY strength DESC, memory_id DESC ROWS UNBOUNDED PRECEDING) AS stays
          FROM m WHERE content IS NOT NULL AND project IS NOT NULL AND strength IS NOT NULL)
        SELECT project, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM t WHERE stays > 600 GROUP BY project""",
    "core_list": f"""WITH {_M} SELECT greatest(1, least(10, round(strength)::INT)) AS importance, count(*) AS n, sum(ceil(length(content) / 3.0))::BIGINT AS tokens FROM m WHERE content IS NOT NULL AND strength IS NOT NULL GROUP BY 1""",
    "branch_sessions": f"""WITH {_SE}, r AS (SELECT min(cwd) AS root FROM se) SELECT session_id, cwd FROM se, r WHERE cwd IS NOT DISTINCT FROM root OR starts_with(cwd, root || '/') OR project = 'proj-amber-lease'""",
    "session_observations": f"""WITH {_SE} SELECT session_id, agent_id, count(DISTINCT obs_id) AS n FROM raw_observations WHERE obs_id IS NOT NULL AND session_id IN (SELECT session_id FROM se WHERE project = 'proj-amber-lease') GROUP BY ALL""",
    "session_changes": """WITH s AS (SELECT session_id, min(started_at) AS started_at, max(observation_count) AS n FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id)
        SELECT CASE WHEN started_at < TIMESTAMP '2026-01-15' THEN 'changed' ELSE 'added' END AS change, count(*) AS n FROM s
        WHERE NOT coalesce(started_at < TIMESTAMP '2026-01-15', false) OR n % 5 = 0 GROUP BY 1""",
    "store_status": f"""WITH {_M}, {_SE} SELECT 'sessions' AS what, count(*) AS n FROM se UNION ALL SELECT 'observations', count(DISTINCT obs_id) FROM raw_observations UNION ALL SELECT 'memories', count(*) FROM m
        UNION ALL SELECT 'latest memories', count(*) FROM m WHERE is_latest UNION ALL SELECT 'open sessions', count(*) FROM se WHERE ended_at IS NULL""",
    "recent_summaries": f"""WITH {_SE} SELECT project, session_id, (row_number() OVER (PARTITION BY project ORDER BY started_at DESC, session_id))::INT AS place FROM se
        WHERE coalesce(trim(summary), '') <> '' AND project IS NOT NULL AND started_at IS NOT NULL QUALIFY place <= 5""",
    "latest_memories": f"WITH {_M} SELECT memory_id, updated_at FROM m WHERE is_latest AND updated_at IS NOT NULL ORDER BY updated_at DESC, memory_id LIMIT 10",
    "team_profile": f"WITH {_M} SELECT agent_id, count(*) AS n, round(avg(strength), 6) AS strength, count(DISTINCT memory_type) AS kinds, count(DISTINCT project) AS projects FROM m WHERE agent_id IS NOT NULL GROUP BY agent_id",
    "team_feed": f"""WITH {_M} SELECT project, memory_id, agent_id, (row_number() OVER (PARTITION BY project ORDER BY created_at DESC, memory_id))::INT AS place FROM m
        WHERE project IS NOT NULL AND agent_id IS NOT NULL AND created_at IS NOT NULL AND coalesce(is_latest, true) QUALIFY place <= 20""",
    "health": """SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.25 THEN 'critical'
        WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.1 THEN 'warning' ELSE 'healthy' END AS state FROM events GROUP BY 1""",
    "healed": f"""WITH {_M}, l AS (SELECT *, row_number() OVER (PARTITION BY coalesce(parent_id, memory_id) ORDER BY version_no DESC NULLS LAST, updated_at DESC NULLS LAST, memory_id) AS r FROM m WHERE is_latest)
        SELECT memory_id, CASE WHEN r > 1 THEN 'superseded' ELSE 'expired' END AS repair FROM l WHERE r > 1 OR forget_after < TIMESTAMP '2026-07-01'""",
}
