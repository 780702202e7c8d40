"""Dense vectors: cosine in column expressions, exact top-k for one query, and blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024  #: queries broadcast at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 for unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def top(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 20) -> DataFrame:
    """(key, score) of the k rows most similar to the query; a scan with a bounded heap per task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def batch_top(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): for every query the k most similar other rows.

    Queries are broadcast in blocks of a fixed size. Each task keeps the k best of its rows per query, so what is
    shuffled is k rows per query and task, not all pairs.
    """
    usable = F.col(vector).isNotNull() & F.col(key).isNotNull()
    spark = rows.sparkSession
    asked = queries.where(usable).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n = asked.count()
    out = None
    parts = max(1, -(-n // block))
    data = rows.where(usable).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()
        shared = spark.sparkContext.broadcast((some["id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in some["v"]]))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vs = shared.value
            best: pd.DataFrame | None = None
            for b in batches:
                sizes = b["v"].map(len)
                for d in sizes.unique():
                    rows_ = b[sizes == d]
                    sel = [i for i, v in enumerate(vs) if len(v) == d]
                    if not sel:
                        continue
                    x, q = np.stack(rows_["v"].map(lambda v: np.asarray(v, np.float64))), np.stack([vs[i] for i in sel])
                    s = np.round(_unit(q) @ _unit(x).T, 6)
                    keys = rows_["key"].to_numpy()
                    o = np.argsort(keys, kind="stable")
                    keys, s = keys[o], s[:, o]
                    s[ids[sel][:, None] == keys[None, :]] = -np.inf
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    got = pd.DataFrame({"query_id": np.repeat(ids[sel], at.shape[1]), "key": keys[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})
                    best = got if best is None else pd.concat([best, got])
                if best is not None:
                    best = best[best["score"] > -np.inf].sort_values(["query_id", "score", "key"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None and len(best):
                yield best

        got = data.mapInPandas(scan, "query_id long, key long, score double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dimensions(rows: DataFrame, key: str, vector: str, expected: int) -> DataFrame:
    """Per length of vector: rows, and whether it is the expected one."""
    return rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dimensions")).agg(F.count("*").alias("n"), (F.first(F.size(vector)) == expected).alias("fits"))
