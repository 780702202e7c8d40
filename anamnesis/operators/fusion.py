"""Fusion of ranked lists, diversification, and packing into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
WEIGHTS = {"bm25": 0.4, "vector": 0.6, "graph": 0.3}


def fused(streams: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score, best_rank, n_streams) from ranked streams (doc, rank): weighted reciprocal ranks.

    The sum over the lists is set in relation to what first places in all lists that found anything would give, and
    grows by a twentieth for every further list that has the document.
    """
    weights = weights or WEIGHTS
    all_ = None
    for name, s in streams.items():
        one = s.groupBy("doc").agg(F.min("rank").alias("rank")).select("doc", "rank", F.lit(name).alias("stream"), F.lit(weights[name]).alias("w"))
        all_ = one if all_ is None else all_.unionByName(one)
    active = all_.select("stream", "w").distinct().agg(F.sum("w").alias("active")).withColumn("one", F.lit(1))
    docs = all_.groupBy("doc").agg(F.sum(F.col("w") / (K + F.col("rank"))).alias("s"), F.min("rank").alias("best_rank"), F.count("*").alias("n_streams")).withColumn("one", F.lit(1))
    docs = docs.join(F.broadcast(active), "one")
    score = F.col("s") / (F.col("active") / (K + 1)) * (1 + 0.05 * (F.col("n_streams") - 1))
    return docs.select("doc", F.round(score, 6).alias("score"), "best_rank", "n_streams")


def ordered(f: DataFrame) -> DataFrame:
    """Fused rows with their place: score, then best rank, then document."""
    return f.orderBy(F.desc("score"), "best_rank", "doc")


def diversified(f: DataFrame, group: str, limit: int, per_group: int = 3) -> DataFrame:
    """At most per_group rows of a group in the first pass, then the others in order, up to limit rows."""
    within = Window.partitionBy(group).orderBy(F.desc("score"), "best_rank", "doc")
    return f.withColumn("later", (F.row_number().over(within) > per_group).cast("int")).orderBy("later", F.desc("score"), "best_rank", "doc").limit(limit).drop("later")


def packed_prefix(rows: DataFrame, order: list, tokens: str, budget: int) -> DataFrame:
    """Rows in order until the first that would exceed the budget; rows are few (the head of a ranking)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_tokens", F.sum(tokens).over(w)).where(F.col("used_tokens") <= budget)


def packed_skipping(rows: DataFrame, by: list[str], order: str, key: str, tokens: str, budget: int) -> DataFrame:
    """Rows per group, newest first, skipping those that do not fit what is left: (by..., key) of the rows kept.

    What fits never grows, so of the rows of one size only the newest budget / size can be kept: a group's fold sees a
    number of rows that is bounded by the budget, however large the group is. Rows of no size always fit.
    """
    size = F.col(tokens)
    newest = Window.partitionBy(*by, tokens).orderBy(F.desc_nulls_last(order), F.desc(key))
    few = rows.where((size > 0) & (size <= budget)).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") * size <= budget)
    blocks = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(tokens).cast("long").alias("t"))), asc=False).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)[key]}>").alias("kept"))
    fits = lambda a, x: a["used"] + x["t"] <= budget
    step = lambda a, x: F.struct(
        F.when(fits(a, x), a["used"] + x["t"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.array_append(a["kept"], x["k"])).otherwise(a["kept"]).alias("kept")
    )
    return blocks.select(*by, F.explode(F.aggregate("b", zero, step)["kept"]).alias(key)).unionByName(rows.where(size <= 0).select(*by, key))
