"""Aggregations over sessions, files, facets and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_values(rows: DataFrame, by: str, values: str, k: int) -> DataFrame:
    """(by, value, n): the k commonest entries of an array column per group; ties go to the smaller value."""
    n = rows.where(F.col(by).isNotNull()).select(by, F.explode(values).alias("value")).where("value is not null").groupBy(by, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "value")
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def cochanged(rows: DataFrame, session: str, file: str, least: int = 3) -> DataFrame:
    """(file_a, file_b, frequency): pairs of files that at least ``least`` sessions touch.

    A pair can only reach the count if both files do, so rarer files are dropped before sessions are joined with
    themselves; a session meets itself once per pair of its frequent files, which is what the result is made of.
    """
    d = rows.where(F.col(session).isNotNull() & F.col(file).isNotNull()).select(F.col(session).alias("s"), F.col(file).alias("f")).distinct()
    often = d.groupBy("f").count().where(F.col("count") >= least).select("f")
    d = d.join(often, "f")
    a, b = d.select("s", F.col("f").alias("file_a")), d.select("s", F.col("f").alias("file_b"))
    return a.join(b, "s").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def repeated_titles(rows: DataFrame, title: str, least: int = 2) -> DataFrame:
    return rows.where(F.col(title).isNotNull()).groupBy(F.lower(title).alias("title")).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def facets(rows: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(target_id, dimension, value): the columns of rows as facets, without duplicates and missing values."""
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dimensions)
    return rows.selectExpr(f"`{key}` as target_id", f"stack({len(dimensions)}, {pairs}) as (dimension, value)").where("value is not null").distinct()


def matching(f: DataFrame, wanted: list[tuple[str, str]], all_: bool) -> DataFrame:
    """Targets with all, or any, of the wanted (dimension, value): counted in one pass, without a join per facet."""
    hit = F.array(*(F.lit(f"{d}:{v}") for d, v in wanted))
    got = f.where(F.array_contains(hit, F.concat_ws(":", "dimension", "value"))).groupBy("target_id").agg(F.countDistinct("dimension", "value").alias("n"))
    return got.where(F.col("n") >= (len(set(wanted)) if all_ else 1)).select("target_id", "n")


def majority(links: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, total): the value that more than half of a key's rows have, or all have."""
    n = links.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return n.where("r = 1 and n * 2 > total").drop("r")


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles as values that occur: the ceil(p/100*n)-th smallest."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(*(F.expr(f"percentile_disc({p / 100}) within group (order by `{value}`)").alias(f"p{p}") for p in percents))


def ranking_quality(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(q, precision, recall, ndcg, mrr) of ranked (q, doc, rank) against gold (q, doc); without results all are 0."""
    n_gold = gold.distinct().groupBy("q").agg(F.count("*").alias("n_gold"))
    r = ranked.where(F.col("rank") <= k).join(gold.distinct().withColumn("hit", F.lit(1)), ["q", "doc"], "left")
    r = r.groupBy("q").agg(
        F.count("*").alias("n"),
        F.count("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return n_gold.join(r, "q", "left").select(
        "q", z(F.col("hits") / F.col("n")).alias("precision"), z(F.col("hits") / F.col("n_gold")).alias("recall"), z(F.col("dcg") / ideal).alias("ndcg"), z(1 / F.col("first")).alias("mrr")
    )


def around(rows: DataFrame, ts: str, key: str, anchor, before: int = 5, after: int = 5) -> DataFrame:
    """(relative, rows...): the row nearest to the anchor time, and so many before and after it in time order.

    Both sides are bounded top-k scans; no sort of the table. Of equally near rows the earlier counts.
    """
    t = F.lit(anchor).cast("timestamp")
    d = rows.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    left = d.where(F.col(ts) <= t).orderBy(F.desc(ts), F.desc(key)).limit(before + 1 + after)
    right = d.where(F.col(ts) > t).orderBy(ts, key).limit(before + 1 + after)
    near = left.unionByName(right)
    w = Window.orderBy(ts, key)  # a handful of rows
    near = near.withColumn("at", F.row_number().over(w)).withColumn("gap", F.abs(F.unix_micros(ts) - F.unix_micros(t)))
    mid = near.orderBy("gap", "at").limit(1).select(F.col("at").alias("mid"), F.lit(1).alias("one"))
    near = near.withColumn("one", F.lit(1)).join(F.broadcast(mid), "one").withColumn("relative", F.col("at") - F.col("mid"))
    return near.where(F.col("relative").between(-before, after)).drop("one", "mid", "at", "gap")
