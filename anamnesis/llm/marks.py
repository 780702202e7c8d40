"""Maps of bits that tell which keys are asked for, so that most others are dropped before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DENSE = 16  #: bits of a place within one block of dense()


def dense(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """An array of so many numbers from rows (at int, value), 0 where there is none.

    The driver gets blocks of bytes and nothing for a single row: as rows, a full map of counters took it gigabytes.
    """
    n = min(size, 1 << DENSE)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at, value = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in np.unique(at >> DENSE).tolist():
                own = at >> DENSE == k
                held.setdefault(k, np.zeros(n, kind))[at[own] & ((1 << DENSE) - 1)] = value[own].astype(kind)
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "bytes"])

    out = np.zeros(size, kind)
    blocks = max(1, min(size >> DENSE, 64))
    for r in rows.repartition(blocks, F.shiftright(F.col(rows.columns[0]), DENSE)).mapInArrow(packed, "block int, bytes binary").collect():
        out[r["block"] * n : (r["block"] + 1) * n] = np.frombuffer(r["bytes"], kind)
    return out


def marked(keys: DataFrame, bits: int) -> np.ndarray:
    """A map of 2**bits bits with those of the one long column's values set: 4 MB for 25 bits, however many keys there are."""
    k = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    got = keys.groupBy(F.shiftright(k, 5).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    return dense(got, 1 << (bits - 5), np.uint32)


def among(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are marked: all that were given, and few others."""
    slot = keys & (32 * len(marks) - 1)
    return (marks[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
