"""Ordered processing of long sequences without ever putting one sequence into one task.

Rows are range-partitioned by sequence and order, so a sequence of any length is spread over neighbouring partitions
and every partition is about as large as any other. A function sees each partition as a sorted stream and gives each
row the partition's number; what crosses an edge is put together afterwards from a few rows per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.plans.scratch import cores


ROWS = 5_000  #: a partition has at least about so many rows, so that few sequences meet an edge


def partitions(df: DataFrame, rows: int | None) -> int:
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark) * 2)
    return n if rows is None else max(1, min(n, rows // ROWS))


def stream(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int | None = None
) -> DataFrame:
    """fn(block, batches) over the range partitions of df, sorted by keys and order; blocks count in that order.

    rows is about how many there are, where that is cheap to tell (a stored table's count).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(TaskContext.get().partitionId(), batches)

    by = [*keys, *order]
    return df.repartitionByRange(partitions(df, rows), *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def previous(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, at and ``before``: the largest smaller value of at in the same group (null for its first row).

    keys are texts and at is a long, both without nulls; equal values count once. A group of any size spans partitions;
    across an edge the last row of the partitions before decides, of which there is one a partition.
    """

    def pairs(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, at, "before", "block", "edge"]
        last: tuple | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            same = np.ones(n, bool)
            same[0] = last is not None and all(b.column(k)[0].as_py() == x for k, x in zip(keys, last[:-1]))
            for k in keys:
                c = b.column(k)
                same[1:] &= pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            value = b.column(at).to_numpy(zero_copy_only=False)
            before = np.concatenate([[last[-1] if last else 0], value[:-1]])
            edge = np.zeros(n, np.int8)
            edge[0] = last is None  # 1: the first row of a partition; 2: its last row, once more
            new = ~(same & (before == value)) if n else same
            cols = [*(b.column(k) for k in keys), b.column(at), pa.array(before, mask=~same), pa.array(np.full(n, block, np.int32)), pa.array(edge)]
            out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out if new.all() else out.filter(pa.array(new))
            last = (*(b.column(k)[n - 1].as_py() for k in keys), int(value[-1]))
        if last:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in last[:-1]), pa.array([last[-1]]), pa.array([None], pa.int64()), pa.array([block], pa.int32()), pa.array([2], pa.int8())], names=names)

    schema = ", ".join([*(f"`{k}` string" for k in keys), f"`{at}` long, before long, block int, edge tinyint"])
    out = stream(df.select(*keys, at), keys, [at], pairs, schema)
    w = Window.partitionBy(*keys).orderBy("block", "edge").rowsBetween(Window.unboundedPreceding, -1)
    seam = out.where("edge > 0").withColumn("before", F.coalesce("before", F.max(F.when(F.col("edge") == 2, F.col(at))).over(w))).where("edge = 1 and (before is null or before < " + f"`{at}`)")
    return out.where("edge = 0").select(*keys, at, "before").unionByName(seam.select(*keys, at, "before"))
