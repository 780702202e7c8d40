"""Ingestion as streams: redacted and normalised observations, sessions, windows, and what needs state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from anamnesis.functions import text as T


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def observations(raw: DataFrame) -> DataFrame:
    """Raw observations, redacted before anything else is made of them, in normal form."""
    clean = raw.withColumns({c: T.redacted(F.col(c)) for c in ("tool_input", "tool_output", "user_prompt", "assistant_response")})
    return T.normalised(clean)


def once_within(raw: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """One row per session, tool and head of input within the delay, by the built-in state store."""
    key = F.sha2(F.concat_ws(":", "session_id", F.coalesce("tool_name", F.lit("")), F.substring(F.coalesce("tool_input", "user_prompt", F.lit("")), 1, 500)), 256)
    return raw.withColumn("dedup_key", key).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def windowed(events: DataFrame, ts: str, by: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and key, complete once the watermark has passed."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), *by, "n")


def sessions(raw: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity of each session in stretches without longer gaps."""
    r = raw.withWatermark("ts", late)
    return r.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def cooled(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events that come at least so many seconds after the last one let through of their key: arbitrary state per key."""
    schema, columns = events.schema, events.columns

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for row in b.sort_values(ts).itertuples(index=False):
                t = int(getattr(row, ts).value // 1000)
                if last is None or t - last >= seconds * 10**6:
                    last = t
                    out.append(row)
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return events.groupBy(key).applyInPandasWithState(fn, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes in what is there, exactly once, into parquet files at path."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def settled(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Takes in what is there and gives the last state of every key of an aggregating stream, open windows included.

    Every epoch writes the keys it changed under its own number (again after a failure), and the last number counts.
    """
    spark, columns = stream.sparkSession, stream.columns
    rest = [c for c in columns if c not in keys]
    schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    take = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/changes/epoch={n}")
    stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(schema).parquet(f"{path}/changes")
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last"))
    return last.select(*keys, "last.*").select(*columns)
