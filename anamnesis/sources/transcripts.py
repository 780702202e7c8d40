"""Chat transcripts in JSON lines: read, and turned into observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: one line as it stands in the files
LINE = (
    "type string, uuid string, sessionId string, timestamp string, cwd string, "
    "message struct<role:string,content:array<struct<type:string,text:string,name:string,input:string,id:string,tool_use_id:string,content:string,is_error:boolean>>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Transcript rows of all ``*.jsonl`` files under path, at any depth; lines that are not JSON are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return parsed(raw)


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Transcript rows of a column of lines. A message whose content is plain text becomes one text block."""
    plain = F.get_json_object(column, "$.message.content")
    d = raw.select(F.from_json(column, LINE, {"mode": "PERMISSIVE"}).alias("l"), plain.alias("plain"), F.col(column).alias("line")).where(F.col("l.type").isNotNull())
    block = lambda b: F.struct(
        b["type"].alias("block_type"), b["text"].alias("text"), b["name"].alias("tool_name"), b["input"].alias("tool_input"), F.coalesce(b["tool_use_id"], b["id"]).alias("tool_use_id"), b["content"].alias("result_text"), b["is_error"].alias("is_error")
    )
    none = F.lit(None).cast("string")
    text = F.array(F.struct(F.lit("text").alias("block_type"), F.col("plain").alias("text"), none.alias("tool_name"), none.alias("tool_input"), none.alias("tool_use_id"), none.alias("result_text"), F.lit(None).cast("boolean").alias("is_error")))
    content = F.when(F.col("l.message.content").isNotNull(), F.transform("l.message.content", block)).when(F.col("plain").isNotNull(), text)
    return d.select(F.col("l.type").alias("row_type"), F.col("l.uuid").alias("uuid"), F.col("l.sessionId").alias("session_id"), F.col("l.timestamp").alias("ts"), F.col("l.cwd").alias("cwd"), F.col("l.message.role").alias("message_role"), content.alias("message_content"))


def observations(rows: DataFrame) -> DataFrame:
    """One row per visible block: prompts, responses, tool calls, results and failures, in their order inside a message."""
    d = rows.select("session_id", "uuid", "ts", "row_type", F.posexplode("message_content").alias("place", "b"))
    kind = F.col("b.block_type")
    hook = (
        F.when((kind == "tool_result") & F.coalesce(F.col("b.is_error"), F.lit(False)), "post_tool_failure")
        .when(kind == "tool_result", "post_tool_use")
        .when(kind == "tool_use", "pre_tool_use")
        .when((kind == "text") & (F.col("row_type") == "user"), "prompt_submit")
        .when((kind == "text") & (F.col("row_type") == "assistant"), "stop")
    )
    d = d.withColumn("hook_type", hook).where(F.col("hook_type").isNotNull() & ((F.col("b.block_type") != "text") | F.col("b.text").rlike(r"\S")))
    return d.select("session_id", "uuid", "place", "hook_type", F.col("b.tool_name").alias("tool_name"), F.col("b.tool_use_id").alias("tool_use_id"), F.coalesce("b.text", "b.tool_input", "b.result_text").alias("content"))
