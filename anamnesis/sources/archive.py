"""Export, import and snapshots of a store: a folder with one table per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.operators.lifecycle import latest_versions


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines under its name; tasks write side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def paged(rows: DataFrame, order: list, offset: int, size: int) -> tuple[DataFrame, bool]:
    """A page of rows and whether there are more; size is at most 1000."""
    size = max(1, min(size, 1000))
    got = rows.orderBy(*order).offset(offset).limit(size + 1)
    return got.limit(size), got.count() > size


def imported(current: DataFrame, incoming: DataFrame, key: str, strategy: str) -> DataFrame:
    """The table after an import: merge overwrites rows of equal key, skip keeps them, replace drops all old rows."""
    if strategy == "replace":
        return incoming
    if strategy == "skip":
        return current.unionByName(incoming.join(current.select(key), key, "left_anti"), allowMissingColumns=True)
    if strategy == "merge":
        return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)
    raise ValueError(f"unknown strategy {strategy!r}")


def upsert(log: DataFrame, key: list[str], version: str) -> DataFrame:
    """Current rows of an append-only log."""
    return latest_versions(log, key, [F.desc(version)])


def snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")


def restored(spark: SparkSession, current: DataFrame, path: str, name: str, snapshot_id: str, key: str) -> DataFrame:
    """Rows of a snapshot put back; rows made since are kept."""
    return imported(current, spark.read.parquet(f"{path}/{name}/snapshot_id={snapshot_id}"), key, "merge")


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON document {nodes: [...], edges: [...]}; edges without both ends are dropped."""
    schema = "nodes array<struct<id:string,type:string,name:string>>, edges array<struct<source:string,target:string,type:string,weight:double>>"
    d = spark.read.schema(schema).option("multiLine", "true").json(path)
    nodes = d.select(F.explode("nodes").alias("n")).select("n.*").where("id is not null").dropDuplicates(["id"])
    edges = d.select(F.explode("edges").alias("e")).select("e.*")
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def markdown(memories: DataFrame) -> DataFrame:
    """(path, text): each memory as a note with front matter, ready to be written by the tasks that hold it."""
    names = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.lit("]"))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "memory_id"), F.concat(F.lit("type: "), F.coalesce("memory_type", F.lit("fact"))), F.concat(F.lit("concepts: "), names(F.col("concepts"))), F.concat(F.lit("files: "), names(F.col("files"))), F.lit("---"))
    text = F.concat(head, F.lit("\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    return memories.where("memory_id is not null and coalesce(is_latest, true)").select(F.concat(F.lit("memories/"), "memory_id", F.lit(".md")).alias("path"), text.alias("text"))


def sections(text: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, heading, body) of the second-level sections of markdown files."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), column), r"\n## "), lambda x: F.length(F.trim(x)) > 0)
    d = text.select(key, F.posexplode(parts).alias("place", "part"))
    return d.select(key, "place", F.trim(F.substring_index("part", "\n", 1)).alias("heading"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def line_budget(rows: DataFrame, by: str, strength: str, key: str, text: str, lines: int) -> DataFrame:
    """The strongest rows per group whose texts fill at most so many lines; rows of a group are few (notes of a project)."""
    w = Window.partitionBy(by).orderBy(F.desc(strength), key).rowsBetween(Window.unboundedPreceding, 0)
    n = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return rows.withColumn("used_lines", F.sum(n).over(w)).where(F.col("used_lines") <= lines)
