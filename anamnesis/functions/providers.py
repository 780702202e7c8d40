"""Where models plug in: text and embedding providers as column functions, with deterministic stand-ins.

A provider is a function from texts to texts or vectors that runs on executors in Arrow batches. It is called with
retries and a breaker per worker that stops calling after repeated failures for a while.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

Text = Callable[[list[str]], list[str]]


class Breaker:
    """Opens after so many failures within a time, and lets one call through again after a pause."""

    def __init__(self, failures: int = 3, within: float = 60.0, pause: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.failures, self.within, self.pause, self.clock = failures, within, pause, clock
        self.failed: deque[float] = deque()
        self.opened: float | None = None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.pause

    def succeeded(self) -> None:
        self.failed.clear()
        self.opened = None

    def fell(self) -> None:
        now = self.clock()
        self.failed.append(now)
        while self.failed and now - self.failed[0] > self.within:
            self.failed.popleft()
        if len(self.failed) >= self.failures:
            self.opened = now


def chained(providers: list[Text], retries: int = 1) -> Text:
    """The first provider that answers; each is retried, and skipped while its breaker is open."""
    breakers = [Breaker() for _ in providers]

    def call(texts: list[str]) -> list[str]:
        error: Exception | None = None
        for p, b in zip(providers, breakers):
            for _ in range(retries + 1):
                if not b.allows():
                    break
                try:
                    out = p(texts)
                    b.succeeded()
                    return out
                except Exception as e:  # noqa: BLE001 whatever a provider raises, the next one is asked
                    error = e
                    b.fell()
        raise RuntimeError("no provider answered") from error

    return call


def first_sentences(texts: list[str]) -> list[str]:
    """Stand-in for a summary: the first two sentences."""
    return [" ".join(t.replace("\n", " ").split(". ")[:2]).strip()[:400] for t in texts]


def answered(text: Column, provider: Text = first_sentences) -> Column:
    """The provider's answer for each text; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = s.notna()
            out = s.copy()
            if some.any():
                out[some] = provider(s[some].tolist())
            yield out

    return F.pandas_udf(run, StringType())(text)


def embedded(text: Column, provider: Callable[[list[str]], list[list[float]]], dim: int) -> Column:
    """Vectors of a provider; any other length than dim is an error, not a wrong index."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if some.any():
                got = provider(s[some].tolist())
                if any(len(v) != dim for v in got):
                    raise ValueError(f"a vector's length differs from {dim}")
                for i, v in zip(s.index[some], got):
                    out[i] = [float(x) for x in v]
            yield out

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def summarised(rows: DataFrame, by: str, order: list[str], text: str, chunk: int = 400, provider: Text = first_sentences) -> DataFrame:
    """(by, summary): texts of a group summarised in chunks of so many rows, and the chunks' summaries once more."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    d = rows.where(F.col(text).isNotNull()).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / chunk)).withColumn("place", F.row_number().over(w))
    joined = lambda d, keys, place, c: d.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, c))), lambda x: x[c]), " ").alias("text"))
    part = joined(d.withColumnRenamed(text, "t"), [by, "chunk"], "place", "t").select(by, "chunk", answered(F.col("text"), provider).alias("t"))
    return joined(part, [by], "chunk", "t").select(by, answered(F.col("text"), provider).alias("summary"))
