"""Property graph as two tables, nodes (node, type, name) and edges (source, target, weight), and searches over it.

Searches go out from a set of start nodes in rounds of joins. Each round joins only the nodes reached last with the
edges, keeps the best label per node before the next round, and writes its result to the shared folder, so plans stay
short and an executor may be lost in any round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.plans.scratch import written

MOST_EDGES = 12  #: edges that one record contributes


def _named(array: str, kind: str) -> Column:
    """Names of an array once each, without blanks, compared without case."""
    clean = F.filter(F.transform(array, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 0)
    return F.transform(F.array_distinct(clean), lambda x: F.concat(F.lit(kind + ":"), x))


def extracted(rows: DataFrame, key: str, concepts: str, files: str) -> DataFrame:
    """(key, source, target) edges a record implies: its concepts to its files, and consecutive concepts and files."""
    c, f = _named(concepts, "concept"), _named(files, "file")
    r = rows.where(F.col(key).isNotNull()).select(key, F.coalesce(c, F.array().cast("array<string>")).alias("c"), F.coalesce(f, F.array().cast("array<string>")).alias("f"))
    cross = F.flatten(F.transform("c", lambda x: F.transform("f", lambda y: F.struct(x.alias("source"), y.alias("target")))))
    chain = lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("source"), F.element_at(a, i + 2).alias("target")))
    edges = F.slice(F.array_distinct(F.concat(cross, chain(F.col("c")), chain(F.col("f")))), 1, MOST_EDGES)
    return r.select(key, F.explode(edges).alias("e")).select(key, "e.source", "e.target").where("source <> target")


def merged(edges: DataFrame, key: str) -> DataFrame:
    """(source, target, weight): how many records imply an edge."""
    return edges.groupBy("source", "target").agg(F.countDistinct(key).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def page(edges: DataFrame, size: int = 500, offset: int = 0) -> DataFrame:
    """The nodes of highest degree, ties by name; a bounded top-k."""
    return degrees(edges).orderBy(F.desc("degree"), "node").offset(offset).limit(size)


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi")


def reached(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within so many undirected steps of a start (node)."""
    e = written(both_ways(edges).select("source", "target").distinct(), "graph-edges")
    seen = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "graph-seen")
    last = seen
    for k in range(1, depth + 1):
        step = last.select(F.col("node").alias("source")).join(e, "source").select(F.col("target").alias("node")).distinct()
        last = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "graph-seen")
        seen = seen.unionByName(last)
    return seen


def cheapest(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, cost, steps): least cost over paths of at most so many steps, a step costing 1 / weight.

    Of equally cheap paths the shorter counts. The labels of a round are reduced to the best per start and node.
    """
    e = written(both_ways(edges).groupBy("source", "target").agg(F.max("weight").alias("weight")), "graph-edges")
    e = e.select("source", "target", (1 / F.greatest(F.col("weight").cast("double"), F.lit(0.01))).alias("step"))
    best = written(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("cost", F.lit(0.0)).withColumn("steps", F.lit(0)), "graph-best")
    for k in range(1, depth + 1):
        more = best.where(F.col("steps") == k - 1).withColumnRenamed("node", "source").join(e, "source")
        more = more.select("start", F.col("target").alias("node"), F.round(F.col("cost") + F.col("step"), 9).alias("cost"), F.lit(k).alias("steps"))
        # a dearer label of fewer steps may still be the only one that can go on, so one label per number of steps stays
        best = written(best.unionByName(more).groupBy("start", "node", "steps").agg(F.min("cost").alias("cost")).select("start", "node", "cost", "steps"), "graph-best")
    w = Window.partitionBy("start", "node").orderBy("cost", "steps")
    return best.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def expanded(edges: DataFrame, links: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, score): records linked to nodes one step from the nodes of the seed records, seeds left out.

    links are (key, node). A record of a seed's own node scores 0.5 / 2, one step further 0.5 / 3.
    """
    own = links.join(seeds.select(key).distinct(), key, "left_semi").select("node").distinct()
    near = own.withColumnRenamed("node", "source").join(both_ways(edges).select("source", "target").distinct(), "source").select(F.col("target").alias("node"))
    nodes = own.withColumn("s", F.lit(0.5 / 2)).unionByName(near.distinct().withColumn("s", F.lit(0.5 / 3))).groupBy("node").agg(F.max("s").alias("s"))
    out = links.join(nodes, "node").groupBy(key).agg(F.round(F.max("s"), 6).alias("score"))
    return out.join(seeds.select(key).distinct(), key, "left_anti")


def unblocked(items: DataFrame, needs: DataFrame, key: str, done) -> DataFrame:
    """Items that are not done and need no unfinished item: needs are (key, on). A need of an unknown item does not block."""
    open_ = items.where(~done).select(F.col(key).alias("on"))
    blocked = needs.join(open_, "on", "left_semi").select(key).distinct()
    return items.where(~done).join(blocked, key, "left_anti")
