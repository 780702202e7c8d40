"""Passages of held-out evaluation items inside training documents, found through FM-indexes.

Each batch of documents is a shard with its own FM-index over words. The windows of LEAST words of all questions and
answers are searched backward through the wavelet ranks, occurrences are located by sampled suffix positions, and
windows that overlap or touch are merged into spans. Words that no item uses cannot be part of an occurrence, nor can
stretches of fewer than LEAST known words, so the index holds only the other stretches; nothing is lost by that.

The items are the stated query set. They are read in slices of about SLICE items and SLICE_BYTES bytes at most, each
broadcast on its own; every shard is read and cut into words once and searched for one slice after the other.

Defined results: null or blank texts, questions and answers have no passages; passages with fewer than LEAST words
cannot leak; equal passages of several items are reported for each item; rows that repeat give equal results once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.fmindex import FMIndex
from anamnesis.plans.scratch import spread

LEAST = 12
SLICE, SLICE_BYTES = 20_000, 32 << 20  #: items searched at once, and bytes of their texts
SHARD = 2_000_000  #: characters of text after which a shard is closed
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def patterns(items: list[tuple[int, str | None, str | None]], least: int = LEAST) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, distinct windows, and for each (window, item) the two numbers."""
    vocab: dict[str, int] = {}
    windows: dict[tuple[int, ...], int] = {}
    uses: set[tuple[int, int]] = set()
    for item, *passages in items:
        for p in passages:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in tokens(p or "")]
            for k in range(len(ids) - least + 1):
                uses.add((windows.setdefault(tuple(ids[k : k + least]), len(windows)), item))
    w = np.array(list(windows), np.int64).reshape(len(windows), least)
    u = np.array(sorted(uses), np.int64).reshape(len(uses), 2)
    return vocab, w, u[:, 0], u[:, 1]


def _occurrences(texts: list[list[str]], vocab: dict[str, int], w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's number, first word, window) of each occurrence in a shard, given as the words of its documents."""
    get = vocab.get
    pieces, docs, offsets, at = [], [], [], 0
    for k, words in enumerate(texts):
        ids = np.fromiter((get(x, 0) for x in words), np.int32, len(words))
        if len(ids) < least:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi - lo >= least:
                pieces += [ids[lo:hi], np.zeros(1, np.int32)]
                docs.append(k)
                offsets.append((at, lo))
                at += hi - lo + 1
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(np.concatenate(pieces))
    lo, hi = index.ranges(w)
    n = hi - lo
    which = np.repeat(np.arange(len(w)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    where = index.locate(rows)
    starts = np.array(offsets, np.int64)
    run = np.searchsorted(starts[:, 0], where, side="right") - 1
    return np.array(docs, np.int64)[run], starts[run, 1] + where - starts[run, 0], which


def spans(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): the stretches of a document that stand in an item's question or answer."""
    spark = documents.sparkSession
    chosen = items.select("item_id", "question", "answer").where("item_id is not null")
    n, size = chosen.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()
    slices = max(1, -(-n // SLICE), -(-(size or 0) // SLICE_BYTES))
    parts = [chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) for k in range(slices)] if slices > 1 else [chosen]
    queries = [spark.sparkContext.broadcast(patterns([tuple(r) for r in part.collect()], least)) for part in parts]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[list[str]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for query in queries:
                vocab, w, use_w, use_item = query.value
                if not len(w):
                    continue
                doc, first, which = _occurrences(held, vocab, w, least)
                if not len(doc):
                    continue
                lo, hi = np.searchsorted(use_w, which, "left"), np.searchsorted(use_w, which, "right")
                n = hi - lo
                doc, first = np.repeat(doc, n), np.repeat(first, n)
                item = use_item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                o = np.lexsort((first, item, doc))
                doc, item, first = doc[o], item[o], first[o]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > first[:-1] + least)])
                a = np.flatnonzero(new)
                z = np.concatenate([a[1:] - 1, [len(doc) - 1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc[a]]), pa.array(item[a]), pa.array(first[a]), pa.array(first[z] + least - 1)], names=["doc_id", "item_id", "first_word", "last_word"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                held.append(tokens(t))
                size += len(t)
                if size >= SHARD:
                    yield from close()
                    ids, held, size = [], [], 0
        if held:
            yield from close()

    return spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInArrow(search, "doc_id long, item_id long, first_word long, last_word long")


def leaked(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least ``least`` consecutive words of the item."""
    return spans(documents, items, least).select("doc_id", "item_id").distinct()


def item_report(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """Per item: documents it leaked into, spans to remove, longest span in words; items without a leak have zeros."""
    s = spans(documents, items, least).distinct()
    n = s.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_spans"), F.max(F.col("last_word") - F.col("first_word") + 1).alias("longest"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return items.select("item_id", "item_type").distinct().join(n, "item_id", "left").select("item_id", "item_type", z("n_docs"), z("n_spans"), z("longest"))
