"""Texts placed into windows of a fixed number of tokens, leaving as little room unused as can be certified.

Texts are measured with a public tokenizer and spread over parts of about PART texts by a hash of their id. Each part
is packed by best-fit decreasing and its number of windows compared with a lower bound from dual feasible functions: no
packing of the part can need fewer. Parts that reach their bound are certified and done. The others hand the texts of
their less filled windows to a common pool with one neighbour at a time, the pool is packed again, and the new packing is
kept if it needs fewer windows; that is repeated ROUNDS times with ever farther neighbours.

A text larger than a window is cut into full windows, and only its rest is packed; other texts are never cut.

Defined results: null texts and rows without id are left out; an empty text takes part with 0 tokens; of repeated ids
the smallest text counts; windows without a positive capacity hold nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.plans.scratch import cores, written

VOCABULARY = "byte_bpe_50k.tiktoken"
PART = 20_000  #: texts of a part
ROUNDS = 2
MOST_KINDS = 1000
RELEASED = 0.97  #: windows filled less than this are packed again in a part with a gap


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) with the tokenizer whose ranks lie at ``vocabulary`` on every machine."""
    place = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(place, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    one = documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    parts = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cores(one.sparkSession))
    one = one.groupBy(key).agg(F.min(text).alias(text)).repartition(parts, key)
    return one.mapInArrow(count, f"{key} long, tokens long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each size, by best-fit decreasing. Open bins are kept by free room in stacks; a bit set finds the tightest."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << free
        else:
            b, free = bins, capacity
            bins += 1
        out[i] = b
        left = free - s
        stacks[left].append(b)
        rooms |= 1 << left
    return out


def dual_sums(sizes: np.ndarray, capacity: int, steps: int = 24) -> np.ndarray:
    """Sums of dual feasible functions, in windows: for each, no packing needs fewer windows than its sum."""
    s = np.sort(sizes.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    out = [total[-1] / capacity]
    for e in np.unique(np.linspace(1, capacity // 2, steps).astype(np.int64)) if capacity > 1 else []:
        # sizes above capacity - e count as full, sizes below e as nothing
        lo, hi = np.searchsorted(s, e), np.searchsorted(s, capacity - e, side="right")
        out.append(((len(s) - hi) * capacity + total[hi] - total[lo]) / capacity)
    for k in range(1, steps):
        # shares of a window are rounded down to k-ths of it unless (k + 1) times the share is whole
        x = (k + 1) * s
        out.append(np.where(x % capacity == 0, s / capacity, (x // capacity) / k).sum())
    return np.array(out + [0.0] * (2 * steps + 1 - len(out)))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return int(np.ceil(dual_sums(sizes, capacity).max() - 1e-9)) if len(sizes) else 0


PLACED = "window_id int, capacity int, part long, doc_id long, piece int, tokens long, bin string, open boolean"


def _pack(round_: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, sizes = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy()
        label = f"{round_}.{pdf['part'].iloc[0]}"
        bins = best_fit(sizes, cap)
        n = int(bins.max()) + 1
        if round_ and n >= pdf["bin"].nunique():  # no better than before: the old windows stay
            pdf["open"] = False
            return pdf
        fill = np.bincount(bins, sizes, minlength=n)
        gap = n > lower_bound(sizes, cap)
        pdf["open"] = (fill[bins] < RELEASED * cap) if gap else False
        pdf["bin"] = [f"{label}-{b}" for b in bins]
        return pdf

    return fn


def _kinds(windows: DataFrame) -> list[tuple[int, int]]:
    """The kinds of windows, which are a setting: MOST_KINDS at most."""
    rows = windows.where("window_id is not null and capacity_tokens > 0").groupBy("window_id").agg(F.min("capacity_tokens")).limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of windows")
    return sorted((int(a), int(b)) for a, b in rows)


def packed(sizes: DataFrame, windows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(window_id, bin, doc_id, piece, tokens): every text of sizes in every kind of window."""
    kinds = [F.struct(F.lit(r[0]).alias("window_id"), F.lit(r[1]).alias("capacity")) for r in _kinds(windows)]
    if not kinds:
        return sizes.sparkSession.createDataFrame([], "window_id int, bin string, doc_id long, piece int, tokens long")
    sizes = written(sizes, "packing-sizes")
    parts = max(1, -(-sizes.count() // PART))
    all_ = sizes.select("doc_id", "tokens", F.inline(F.array(*kinds))).withColumn("full", F.floor(F.col("tokens") / F.col("capacity")).cast("int")).withColumn("rest", F.col("tokens") % F.col("capacity"))
    cut = all_.where("full > 0").select("window_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").cast("long").alias("tokens"))
    cut = cut.withColumn("bin", F.concat_ws("-", F.lit("full"), "doc_id", "piece"))
    todo = all_.where("rest > 0 or tokens = 0").select(
        "window_id", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), "doc_id", F.col("full").alias("piece"), F.col("rest").alias("tokens"), F.lit("").alias("bin"), F.lit(True).alias("open")
    )
    done = written(todo.groupBy("window_id", "part").applyInPandas(_pack(0), PLACED), "packing-round")
    for round_ in range(rounds if parts > 1 else 0):
        closed = done.where("not open")
        again = done.where("open").withColumn("part", F.floor(F.col("part") / 2))
        again = again.groupBy("window_id", "part").applyInPandas(_pack(round_ + 1), PLACED)
        done = written(closed.unionByName(again), "packing-round")
    names = ["window_id", "bin", "doc_id", "piece", "tokens"]
    return done.select(names).unionByName(cut.select(names))


def report(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: bins used, the bound below which no packing of all texts can go, and the share of room unused."""
    p = packed(sizes, windows)
    caps = windows.select(F.col("window_id").cast("int"), "window_name", F.col("capacity_tokens").cast("int").alias("capacity"))
    used = p.groupBy("window_id").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity"].iloc[0])
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[:1], "sums": [dual_sums(pdf["tokens"].to_numpy(), cap)]})

    pieces = p.join(caps, "window_id").select("window_id", "capacity", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("salt"))
    part = pieces.groupBy("window_id", "salt").applyInPandas(sums, "window_id int, sums array<double>").select("window_id", F.posexplode("sums").alias("k", "x"))
    bound = part.groupBy("window_id", "k").agg(F.sum("x").alias("x")).groupBy("window_id").agg(F.ceil(F.max("x") - 1e-6).alias("lower_bound"))
    out = caps.join(used, "window_id").join(bound, "window_id")
    return out.select("window_id", "window_name", "bins", "lower_bound", F.round(1 - F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("unused_share"))
