"""Retrieval as users ask for it: one table of observations and memories, searched with filters, formats and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import estimated_tokens
from anamnesis.operators import fusion, lexical


def memory_rows(memories: DataFrame) -> DataFrame:
    """Latest memories with title and content, in the form that observations have."""
    m = memories.where("memory_id is not null and coalesce(is_latest, true) and title is not null and content is not null")
    return m.select(
        F.col("memory_id").alias("doc"),
        F.coalesce(F.try_element_at("session_ids", F.lit(1)), F.lit("memory")).alias("session_id"),
        "project",
        "agent_id",
        F.lit("decision").alias("type"),
        "title",
        F.col("content").alias("narrative"),
        "concepts",
        "files",
        F.col("strength").alias("importance"),
        F.col("updated_at").alias("ts"),
    )


def observation_rows(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations with title and narrative; project and agent are those of their session, once per session."""
    s = sessions.where("session_id is not null").groupBy("session_id").agg(F.min("project").alias("project"), F.min("agent_id").alias("agent_id"))
    o = history.where("obs_id is not null and title is not null and narrative is not null").dropDuplicates(["obs_id"])
    none = F.array().cast("array<string>")
    return o.join(s, "session_id", "left").select(
        F.col("obs_id").alias("doc"), "session_id", "project", "agent_id", F.col("obs_type").alias("type"), "title", "narrative", none.alias("concepts"), F.array("file_path").alias("files"), F.col("importance").cast("double").alias("importance"), "ts"
    )


def search(
    spark: SparkSession, rows: DataFrame, query: str, limit: int = 20, project: str | None = None, agent: str | None = None, form: str = "full", budget: int | None = None, expand: bool = False
) -> DataFrame:
    """The best rows for a query. Filters come before ranking, so no row is lost to another project's hits.

    Rows without project belong to every project. form is full, compact (ids, titles and scores) or narrative (numbered
    texts); budget keeps rows in order while their texts fit. limit is between 1 and 100.
    """
    r = rows
    if project is not None:
        r = r.where(F.coalesce("project", F.lit(project)) == project)
    if agent not in (None, "*"):
        r = r.where(F.col("agent_id") == agent)
    text = F.concat_ws(" ", "title", "narrative", "concepts", "files", "type")
    hits = lexical.searched(r, "doc", text, lexical.terms_of(spark, query, expand), prefixes=True)
    head = hits.orderBy(F.desc("score"), "doc").limit(max(1, min(limit, 100))).select("doc", "score").join(r, "doc")
    if budget is not None:
        head = fusion.packed_prefix(head.withColumn("tokens", F.greatest(F.lit(1), estimated_tokens("narrative"))), [F.desc("score"), F.col("doc")], "tokens", budget)
    if form == "compact":
        return head.select("doc", "session_id", "type", "title", "ts", "score")
    if form == "narrative":
        place = F.row_number().over(Window.orderBy(F.desc("score"), "doc"))  # at most 100 rows
        return head.select("doc", "score", F.format_string("%d. %s: %s", place, "title", "narrative").alias("text"))
    return head.select("doc", "session_id", "project", "agent_id", "type", "title", "narrative", "files", "importance", "ts", "score")


def file_context(history: DataFrame, sessions: DataFrame, project: str, files: list[str], newest: int = 15, k: int = 5) -> DataFrame:
    """(file, obs_id, title, importance, place): what the newest sessions of a project noted about the asked files.

    A file is meant if a noted path is the asked one or ends with it after a slash, or the other way round.
    """
    s = sessions.where((F.col("project") == project) & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("started_at").alias("started_at"))
    s = s.orderBy(F.desc("started_at"), "session_id").limit(newest).select("session_id")
    o = history.where("obs_id is not null and importance >= 4").dropDuplicates(["obs_id"]).join(s, "session_id", "left_semi")
    asked = F.explode(F.array(*map(F.lit, files)))
    o = o.select("*", asked.alias("file"))
    same = (F.col("file_path") == F.col("file")) | F.endswith(F.col("file_path"), F.concat(F.lit("/"), "file")) | F.endswith(F.col("file"), F.concat(F.lit("/"), "file_path"))
    w = Window.partitionBy("file").orderBy(F.desc("importance"), F.desc("ts"), "obs_id")
    return o.where(same).withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= k).select("file", "obs_id", "title", "importance", "place")


def working_score(importance, accesses, days):
    """Weight of an entry of working memory."""
    return 0.5 * importance / 10 + 0.3 / (1 + 0.1 * days) + 0.2 * F.log2(accesses + 1) / 10
