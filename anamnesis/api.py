"""One object over a folder of stored tables, with the retrieval and analysis functions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions import text
from anamnesis.operators import analytics, graph, lifecycle, retrieve, vector
from anamnesis.sources.tables import table


class Store:
    """Functions take keyword arguments and return DataFrames; a search reads what it needs of the tables while its DataFrame is built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.functions: dict[str, Callable[..., DataFrame]] = {
            "search": self.search, "smart-search": self.smart_search, "vision-search": self.vision_search, "timeline": self.timeline, "file-context": self.file_context, "profile": self.profile,
            "patterns": self.patterns, "facet-query": self.facet_query, "facet-stats": self.facet_stats, "retention-score": self.retention_score, "privacy": self.privacy, "graph-query": self.graph_query,
            "replay-sessions": self.replay_sessions, "verify": self.verify,
        }

    def call(self, name: str, **payload) -> DataFrame:
        if name not in self.functions:
            raise KeyError(f"no function {name!r}; there are {', '.join(sorted(self.functions))}")
        return self.functions[name](**payload)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def _rows(self) -> DataFrame:
        observations = retrieve.observation_rows(self.table("file_history"), self.table("sessions"))
        return observations.unionByName(retrieve.memory_rows(self.table("memories")))

    def search(self, query: str, limit: int = 20, project: str | None = None, agent: str | None = None, form: str = "full", budget: int | None = None) -> DataFrame:
        return retrieve.search(self.spark, self._rows(), query, limit, project, agent, form, budget)

    def smart_search(self, query: str, limit: int = 20, project: str | None = None) -> DataFrame:
        return retrieve.search(self.spark, self._rows(), query, limit, project, form="compact", expand=True)

    def vision_search(self, query: list[float], session: str | None = None, top_k: int = 10) -> DataFrame:
        v = self.table("image_vectors").dropDuplicates(["image_ref"])
        return vector.top(v.where(F.col("session_id") == session) if session else v, "image_ref", "vector", query, max(1, min(top_k, 50)))

    def timeline(self, anchor: str, before: int = 5, after: int = 5) -> DataFrame:
        return analytics.around(self.table("timeline_events").dropDuplicates(["event_id"]), "ts", "event_id", anchor, before, after)

    def file_context(self, project: str, files: list[str]) -> DataFrame:
        return retrieve.file_context(self.table("file_history"), self.table("sessions"), project, files)

    def profile(self, project: str, k: int = 15) -> DataFrame:
        return analytics.top_values(self.table("memories").where(F.col("project") == project), "project", "concepts", k)

    def patterns(self, least: int = 3, k: int = 20) -> DataFrame:
        return analytics.cochanged(self.table("file_history"), "session_id", "file_path", least).orderBy(F.desc("frequency"), "file_a", "file_b").limit(k)

    def facet_query(self, wanted: list[tuple[str, str]], match_all: bool = True) -> DataFrame:
        return analytics.matching(analytics.facets(self.table("memories"), "memory_id", ["memory_type", "agent_id", "project"]), wanted, match_all)

    def facet_stats(self) -> DataFrame:
        return analytics.facets(self.table("memories"), "memory_id", ["memory_type", "agent_id", "project"]).groupBy("dimension", "value").count()

    def retention_score(self, as_of: str) -> DataFrame:
        m = self.table("memories").where("coalesce(is_latest, false)")
        score = lifecycle.retention(F.col("memory_type"), F.col("created_at"), F.array().cast("array<timestamp>"), as_of)
        return m.select("memory_id", score.alias("score")).withColumn("tier", lifecycle.tier(F.col("score")))

    def privacy(self, column: str = "tool_output") -> DataFrame:
        return self.table("raw_observations").select("obs_id", text.redacted(F.col(column)).alias(column))

    def graph_query(self, start: str | None = None, depth: int = 2, size: int = 500, offset: int = 0) -> DataFrame:
        e = graph.merged(graph.extracted(self.table("memories"), "memory_id", "concepts", "files"), "memory_id")
        return graph.page(e, min(size, 5000), offset) if start is None else graph.reached(e, self.spark.createDataFrame([(start,)], "node string"), max(1, min(depth, 8)))

    def replay_sessions(self) -> DataFrame:
        return self.table("sessions").dropDuplicates(["session_id"]).orderBy(F.desc("started_at"), "session_id")

    def verify(self) -> DataFrame:
        o = self.table("raw_observations").select("obs_id", "session_id").dropDuplicates(["obs_id"])
        return self.table("memories").select("memory_id", F.explode("source_observation_ids").alias("obs_id")).distinct().join(o, "obs_id", "left")
