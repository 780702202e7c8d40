"""Relational operators over items that wait for others: what is free, held, gated, threaded, or to be removed with its parent.

Items, edges, holds and gates are tables of any size. Everything is anti joins, grouped counts and windows over keys of
single items; no group is collected.

Defined results: edges whose ends are missing never block; rows without key are left out; equal scores go to the smaller
key; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked(items: DataFrame, edges: DataFrame, key: str, open_: Column) -> DataFrame:
    """(key): sources of edges (source, target) whose target is an open item."""
    targets = items.where(open_).select(F.col(key).alias("target"))
    return edges.join(targets, "target", "left_semi").select(F.col("source").alias(key)).distinct()


def free(items: DataFrame, key: str, open_: Column, active: Column, requires: DataFrame, gated: DataFrame, conflicts: DataFrame, held: DataFrame) -> DataFrame:
    """Open items without open requirement, gate (key), active conflict in either direction, or hold (key)."""
    both = conflicts.unionByName(conflicts.select(F.col("target").alias("source"), F.col("source").alias("target")))
    stops = [blocked(items, requires, key, open_), blocked(items, both, key, active), gated.select(key), held.select(key)]
    return items.where(open_ & F.col(key).isNotNull()).join(reduce(DataFrame.unionByName, stops).distinct(), key, "left_anti")


def urgency(priority: Column, age_hours: Column, unlocks: Column, active: Column) -> Column:
    """Fixed weights: priority 10, half a point an hour up to 20, 5 for each item it unlocks, 15 if it is begun."""
    return F.round(10 * priority + F.least(0.5 * age_hours, F.lit(20.0)) + 5 * unlocks + F.when(active, 15).otherwise(0), 2)


def current_holds(holds: DataFrame, key: str, begun: str, expires: str, tie: str, at: str) -> DataFrame:
    """The latest hold of every key that is in force at a time."""
    t = F.lit(at).cast("timestamp")
    w = Window.partitionBy(key).orderBy(F.desc(begun), F.desc(tie))
    return holds.where((F.col(begun) <= t) & (F.col(expires) > t) & F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def all_passed(links: DataFrame, key: str, passed: Column) -> DataFrame:
    """(key): keys all of whose linked gates have passed."""
    return links.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_and(F.coalesce(passed, F.lit(False))).alias("ok")).where("ok").select(key)


def dependent_steps(steps: DataFrame, run: str, number: str, depends_on: str) -> DataFrame:
    """(run, source, target): an edge for each step number in a step's array of dependencies that is a step of the run."""
    wants = steps.select(run, F.col(number).alias("source"), F.explode(F.array_distinct(depends_on)).alias("target"))
    return wants.join(steps.select(run, F.col(number).alias("target")).distinct(), [run, "target"], "left_semi")


def without(items: DataFrame, edges: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and edges that are left when the items in gone (key) are deleted with all edges at them."""
    left = edges
    for end in ("source", "target"):
        left = left.join(gone.select(F.col(key).alias(end)), end, "left_anti")
    return items.join(gone, key, "left_anti"), left.select(*edges.columns)


def threads(messages: DataFrame, thread: Column, at: str, who: list[str]) -> DataFrame:
    """(thread, n, last, participants): messages by thread, with the distinct names in the given columns."""
    m = messages.select(thread.alias("thread"), at, F.explode(F.array(*who)).alias("who")).where("thread is not null")
    names = m.where("who is not null").groupBy("thread", "who").agg(F.lit(1).alias("one")).groupBy("thread").agg(F.count("*").alias("participants"))
    n = messages.select(thread.alias("thread"), at).where("thread is not null").groupBy("thread").agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return n.join(names, "thread", "left").select("thread", "n", "last", F.coalesce("participants", F.lit(0)).alias("participants"))


def overrides(special: DataFrame, general: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value, special): every label once, the special value before the general one."""
    a = special.select(label, F.col(value).alias("_a"), F.lit(True).alias("special"))
    b = general.select(label, F.col(value).alias("_b"))
    return a.join(b, label, "full_outer").select(label, F.coalesce("_a", "_b").alias(value), F.coalesce("special", F.lit(False)).alias("special"))


def paged_out(rows: DataFrame, by: str, order: list, size: str, budget: Column) -> DataFrame:
    """Rows in order from the least worth on that must go until what stays of a group is within its budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("_stays", F.sum(size).over(w)).where(F.col("_stays") > budget).drop("_stays")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): rows that were added, removed or changed between two states of a table with one row a key."""
    x = before.select(key, F.struct(*columns).alias("_x"))
    y = after.select(key, F.struct(*columns).alias("_y"))
    kind = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return x.join(y, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def updated(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the non-null values of their patch (one row a key) put over their own; patches of unknown keys add nothing."""
    p = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    own = [F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(p, key, "left").select(*own)
