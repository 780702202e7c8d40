"""Runs of identical or near-identical consecutive events, collapsed to one event with count and duration.

Per sequence the runs are an optimal segmentation: dynamic programming with pruning minimises, over all ways to cut,
``weight`` for every event that differs from the event its segment stands for plus ``penalty`` for every segment.
With weight above twice the penalty (the strict setting) no segment mixes different events, so the segments are
exactly the maximal stretches of equal neighbours; a smaller weight lets a segment bridge single odd events.

For each event that an open segment may stand for, the cheapest such segment is kept, and dropped once it costs a
penalty more than the best one: a new segment would then be as cheap. What all kept segments share is emitted.

Events of one sequence may be spread over several partitions (see plans.ordered). A stretch of n equal events with
weight * n > 2 * penalty is never the odd part of a segment, so between two such neighbours a cut is certain, and the
sequence falls into chunks that do not depend on each other. Chunks inside a partition are segmented there; the stretches
of chunks that reach an edge are put together and segmented as a stream. The result is that of the whole sequence,
whatever the partitions.

Defined results: rows without event id or sequence id are left out; of several rows with one event id the smallest
counts; events are ordered by time, missing times first, then event id; names of tools are compared without case,
blanks and punctuation, and a blank name counts as missing; an empty table has no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.plans.ordered import stream

STRICT, LENIENT = (3.0, 1.0), (1.5, 1.0)  #: (weight, penalty)


class Segmenter:
    """Optimal segments of stretches (code, first id, last id, count, start, end, last duration), given one after another."""

    def __init__(self, weight: float, penalty: float):
        self.weight, self.penalty = weight, penalty
        self.open: dict[str, tuple] = {}  # code: cost, first id, start, events before, closed segments before as a linked list
        self.total = 0
        self.last: tuple | None = None

    def _closed(self) -> tuple[float, tuple | None]:
        """The cheapest way to end here: its cost, and its segments as a linked list."""
        if not self.open:
            return 0.0, None
        code, (cost, first, start, before, chain) = min(self.open.items(), key=lambda x: (x[1][0], x[1][3]))
        return cost, ((code, first, self.last[2], self.total - before, start, self.last[5], self.last[6]), chain)

    def add(self, stretch: tuple) -> list[tuple]:
        """Takes a stretch in and gives the segments that are now certain."""
        code, first, _, n, start = stretch[:5]
        cost, chain = self._closed()
        odd = self.weight * n
        kept = {c: (x[0] + odd, *x[1:]) for c, x in self.open.items() if c != code}
        own = self.open.get(code)
        kept[code] = own if own and own[0] <= cost + self.penalty else (cost + self.penalty, first, start, self.total, chain)
        self.total += n
        self.last = stretch
        most = min(x[0] for x in kept.values()) + self.penalty + 1e-9
        self.open = {c: x for c, x in kept.items() if x[0] <= most}
        if len(self.open) > 1:
            return []
        ((only, x),) = self.open.items()
        self.open = {only: (*x[:4], None)}
        return _unlinked(x[4])

    def end(self) -> list[tuple]:
        out = _unlinked(self._closed()[1])
        self.open, self.total = {}, 0
        return out


def _unlinked(chain: tuple | None) -> list[tuple]:
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def segment(codes: list, counts: list[int], weight: float, penalty: float) -> list[tuple[int, int]]:
    """Optimal segments [lo, hi) of stretches that are given as codes with counts."""
    s = Segmenter(weight, penalty)
    out = [x for k, (c, n) in enumerate(zip(codes, counts)) for x in s.add((c, k, k + 1, n, None, None, None))] + s.end()
    return [(x[1], x[2]) for x in out]


def prepared(events: DataFrame) -> DataFrame:
    """One row per event with the code that tells whether neighbours are alike."""
    name = F.regexp_replace(F.lower("tool_name"), r"[^\p{L}\p{N}]+", "")
    code = F.concat(F.coalesce(F.concat(F.lit("k"), "kind"), F.lit("-")), F.lit("\u0001"), F.when(F.length(name) > 0, F.concat(F.lit("t"), name)).otherwise("-"))
    return (
        events.where("event_id is not null and session_id is not null")
        .groupBy("event_id")
        .agg(F.min(F.struct("session_id", "ts", code.alias("code"), "duration_ms")).alias("e"))
        .select("event_id", "e.*")
    )


RUN = "session_id string, block int, run int, raw boolean, begins boolean, code string, first_event_id string, last_event_id string, n_events long, started timestamp, ended timestamp, last_ms long"
NAMES = [x.split()[0] for x in RUN.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)


def _partition_runs(weight: float, penalty: float):
    """Segments of the chunks inside a partition, and (raw) the stretches of those that reach its edges; begins: a chunk begins here."""

    def fn(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chunk: list[tuple] = []  # stretches since the last certain cut
        now: list | None = None  # the stretch that is being read
        session, at_edge, number = None, True, 0

        def close(last: bool) -> None:
            nonlocal chunk, at_edge, number
            if at_edge or last:
                rows.extend((session, block, number + k, True, k == 0 and not at_edge, *x) for k, x in enumerate(chunk))
                number += len(chunk)
            else:
                s = Segmenter(weight, penalty)
                for x in [seg for y in chunk for seg in s.add(y)] + s.end():
                    rows.append((session, block, number, False, True, *x))
                    number += 1
            chunk, at_edge = [], False

        def read() -> None:
            """The stretch is over."""
            nonlocal now
            if now:
                if chunk and weight * min(chunk[-1][3], now[3]) > 2 * penalty:
                    close(False)
                chunk.append(tuple(now))
                now = None

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("session_id", "code", "event_id")]
            ts = b.column("ts").cast(pa.int64()).to_pylist()
            for s, c, e, t, ms in zip(*cols, ts, b.column("duration_ms").to_pylist()):
                if s != session:
                    read()
                    if session is not None:
                        close(False)
                    session = s
                if now and now[0] == c:
                    now[2], now[3], now[5], now[6] = e, now[3] + 1, t, ms
                else:
                    read()
                    now = [c, e, e, 1, t, t, ms]
            if len(rows) > 20_000:
                yield _batch(rows)
                rows.clear()
        read()
        if chunk:
            close(True)
        if rows:
            yield _batch(rows)

    return fn


def _edge_runs(weight: float, penalty: float):
    """Segments of chunks whose stretches come in order, those that an edge divided being joined."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, s, now = None, Segmenter(weight, penalty), None
        for b in batches:
            rows: list[tuple] = []
            cols = [b.column(c) for c in ("session_id", "chunk", *NAMES[5:])]
            cols = [x.cast(pa.int64()) if pa.types.is_timestamp(x.type) else x for x in cols]
            for name, number, *x in zip(*(c.to_pylist() for c in cols)):
                if (name, number) != chunk:
                    if now:
                        rows += [(chunk[0], 0, 0, False, True, *y) for y in s.add(now) + s.end()]
                    chunk, now = (name, number), None
                if now and now[0] == x[0]:
                    now = (now[0], now[1], x[2], now[3] + x[3], now[4], *x[5:])
                else:
                    if now:
                        rows += [(name, 0, 0, False, True, *y) for y in s.add(now)]
                    now = tuple(x)
            if rows:
                yield _batch(rows)
        if now:
            yield _batch([(chunk[0], 0, 0, False, True, *y) for y in s.add(now) + s.end()])

    return fn


def collapsed(events: DataFrame, weight: float = STRICT[0], penalty: float = STRICT[1]) -> DataFrame:
    """Every run: (session_id, code, first_event_id, last_event_id, n_events, started, ended, lasted_ms)."""
    r = stream(prepared(events), ["session_id"], ["ts", "event_id"], _partition_runs(weight, penalty), RUN)
    w = Window.partitionBy("session_id").orderBy("block", "run")
    edges = r.where("raw").withColumn("chunk", F.sum(F.col("begins").cast("int")).over(w))
    edges = edges.repartition("session_id", "chunk").sortWithinPartitions("session_id", "chunk", "block", "run").mapInArrow(_edge_runs(weight, penalty), RUN)
    names = ["session_id", "code", "first_event_id", "last_event_id", "n_events", "started", "ended", "last_ms"]
    out = r.where("not raw").select(names).unionByName(edges.select(names))
    lasted = F.unix_millis("ended") - F.unix_millis("started") + F.greatest(F.coalesce("last_ms", F.lit(0)), F.lit(0))
    return out.select(*names[:-1], lasted.alias("lasted_ms"))


def repeated(events: DataFrame) -> DataFrame:
    """Maximal stretches of two or more equal neighbours (session_id, first_event_id, last_event_id)."""
    return collapsed(events).where("n_events > 1").select("session_id", "first_event_id", "last_event_id")
