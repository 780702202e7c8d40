"""Decay, retention, eviction, expiry and versions. Every score takes the time it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000.0
DECAY, REINFORCE = 0.01, 0.3
TIERS = {"hot": 0.7, "warm": 0.4, "cold": 0.15}
# How much a kind of memory matters before it is used.
KIND_WEIGHTS = {"architecture": 0.9, "bug": 0.7, "pattern": 0.8, "preference": 0.85, "workflow": 0.6, "fact": 0.5}
RECENT_ACCESSES = 20


def days_since(ts: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / DAY_US


def salience(kind: Column, accesses: Column) -> Column:
    base = F.lit(0.5)
    for k, w in KIND_WEIGHTS.items():
        base = F.when(kind == k, w).otherwise(base)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), accesses * 0.02))


def retention(kind: Column, created: Column, accesses: Column, as_of: str) -> Column:
    """Salience that decays with age, raised by recent accesses (array of times), at most 1."""
    used = F.slice(F.reverse(F.array_sort(accesses)), 1, RECENT_ACCESSES)
    boost = F.aggregate(used, F.lit(0.0), lambda a, t: a + F.when(days_since(t, as_of) > 0, 1 / days_since(t, as_of)).otherwise(0.0)) * REINFORCE
    return F.least(F.lit(1.0), salience(kind, F.size(accesses)) * F.exp(-DECAY * days_since(created, as_of)) + boost)


def tier(score: Column) -> Column:
    out = F.lit("evictable")
    for name, least in sorted(TIERS.items(), key=lambda x: x[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def recent_accesses(events: DataFrame, key: str, ts: str, k: int = RECENT_ACCESSES) -> DataFrame:
    """(key, n, accesses): how often a key was used, and its k latest times; older ones are dropped before they are gathered."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    kept = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(key).agg(F.array_sort(F.collect_list(ts)).alias("accesses"))
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("last")).join(kept, key)


def decayed_strength(strength: Column, days: Column) -> Column:
    """A tenth off for each full month once a month has passed, never under a tenth."""
    return F.when(days > 30, F.greatest(F.lit(0.1), strength * F.pow(F.lit(0.9), F.floor(days / 30)))).otherwise(strength)


def swept_confidence(confidence: Column, days: Column, rate: float = 0.05) -> Column:
    weeks = days / 7
    return F.when(weeks >= 1, F.round(F.greatest(F.lit(0.05), confidence - rate * weeks), 3)).otherwise(confidence)


def reinforced(c0: Column, times: Column, gain: float = 0.1) -> Column:
    """Confidence after so many repeats, each closing a share of what is missing to 1."""
    return 1 - (1 - c0) * F.pow(F.lit(1 - gain), times)


def latest_versions(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the last in order: upsert on append-only tables."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_writer_wins(local: DataFrame, remote: DataFrame, key: str, ts: str) -> DataFrame:
    """Both replicas merged: per key the newer row, the local one if equally new."""
    both = local.withColumn("is_local", F.lit(1)).unionByName(remote.withColumn("is_local", F.lit(0)))
    return latest_versions(both, [key], [F.desc_nulls_last(ts), F.desc("is_local")])


def edge_versions(edges: DataFrame, key: list[str], commit: str, tie: str) -> DataFrame:
    """Versions of edges with one key: number, time of closing, and which is the latest."""
    w = Window.partitionBy(*key).orderBy(commit, tie)
    return edges.withColumn("version", F.row_number().over(w)).withColumn("valid_end", F.lead(commit).over(w)).withColumn("is_latest", F.col("valid_end").isNull())


def as_of(edges: DataFrame, key: list[str], commit: str, tie: str, at: str) -> DataFrame:
    """The edges as they were known and valid at a time: of each key the last one committed by then."""
    known = edges.where(F.col(commit) <= F.lit(at).cast("timestamp"))
    return latest_versions(known, key, [F.desc(commit), F.desc(tie)])


def kept_by_ttl(rows: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Rows that open a window in which repeats of their key are dropped; repeats do not lengthen it.

    A fold over the sorted times of each key. Times of one key are gathered as 8 bytes each; a key with very many rows
    is first cut at gaps longer than the window, where every fold starts anew whatever came before.
    """
    w = Window.partitionBy(*key).orderBy("t")
    d = rows.where(F.col(ts).isNotNull()).select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).groupBy(*key, "t").agg(F.count("*").alias("n"))
    d = d.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= seconds * 10**6, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    zero = F.struct(F.lit(-(1 << 62)).cast("long").alias("open"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, t: F.when(t - seconds * 10**6 > a["open"], F.struct(t.alias("open"), F.array_append(a["kept"], t).alias("kept"))).otherwise(a)
    d = d.groupBy(*key, "g").agg(F.aggregate(F.sort_array(F.collect_list("t")), zero, step)["kept"].alias("kept"), F.sum("n").alias("rows"))
    return d.groupBy(*key).agg(F.sum("rows").alias("rows"), F.sum(F.size("kept")).alias("kept"))
