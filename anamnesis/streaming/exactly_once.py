"""Exactly one copy of messages that were delivered at least once.

A stream of rows is read in micro-batches, and a micro-batch is taken in as one epoch, or, where a stored table is
replayed, as SLICES epochs in the order of delivery, however large it is. A keyed store remembers the identifiers seen:

* live    identifiers whose latest event time is not below the watermark (largest event time so far less ``delay``);
* archive identifiers that the watermark has passed; they leave the live store, which therefore stays as large as the
          window of expected redelivery, and are looked up by bucket of their hash, so a copy that arrives however
          late is still recognised. Archive parts are merged four at a time, so there are few of them, and an
          identifier is rewritten a logarithmic number of times.

An epoch writes its rows (with the verdict whether they were seen), then the new live store and the newly archived
identifiers, then a commit file that names all of these parts and the watermark. The commit file is moved into place
as a whole: readers and later epochs see all of an epoch or nothing, and an epoch that is replayed after a failure
overwrites its own parts. Cutting a micro-batch into slices is stored too, so a replay cuts it the same way.

Copies of one identifier inside an epoch are combined before the shuffle, so an identifier that holds a third of all
rows moves as one row per input task.

Defined results: rows whose identifier has a null part cannot be told apart and are left out; of the copies in one
epoch the earliest received is kept (ties: smallest row); rows without event time never expire anything and count as
older than any watermark; rows without delivery time come first; an empty input gives empty tables.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from anamnesis.plans.scratch import new_dir, remove

EXPECTED_DELAY = "7 days"
SLICES = 3  #: epochs in which a stored table is replayed
BUCKETS = 4096  #: of the archive; merged parts are sorted by them
MERGED = 4  #: archive parts of one size that become one


@dataclass
class Delivered:
    """Committed output of a run: kept rows, and suppressed counts per identifier."""

    spark: SparkSession
    path: str
    epochs: list[int]
    kept_schema: str
    key_schema: str

    def _read(self) -> DataFrame:
        schema = f"{self.key_schema}, n long, row struct<{self.kept_schema}>, seen boolean"
        if not self.epochs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/epoch={e}" for e in self.epochs))

    @property
    def kept(self) -> DataFrame:
        return self._read().where("not seen").select("row.*")

    @property
    def suppressed(self) -> DataFrame:
        """(keys..., n): copies beyond the first, per epoch in which there were some."""
        keys = [k.strip().split()[0].strip("`") for k in self.key_schema.split(",")]
        return self._read().select(*keys, F.when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1).alias("n")).where("n > 0")


class SeenStore:
    """The keyed store and its epochs in one folder."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], key_schema: str, delay: str = EXPECTED_DELAY):
        self.spark, self.path, self.keys, self.key_schema, self.delay = spark, path, keys, key_schema, delay
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def state(self) -> dict:
        """What the last commit names: epochs so far, watermark, the live part, and (level, part) of the archive."""
        folder = self.at(f"{self.path}/commits")
        if not self.fs.exists(folder):
            return {"epochs": 0, "watermark": None, "live": None, "archive": []}
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]  # two at most stay
        stream = self.fs.open(self.at(folder, max(n for n in names if n.isdigit())))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def committed(self) -> list[int]:
        return list(range(self.state()["epochs"]))

    def _commit(self, state: dict) -> None:
        name = f"{state['epochs']:012d}"
        out = self.fs.create(self.at(f"{self.path}/open/{name}"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.fs.mkdirs(self.at(f"{self.path}/commits"))
        if not self.fs.rename(self.at(f"{self.path}/open/{name}"), self.at(f"{self.path}/commits/{name}")):
            raise OSError(f"epoch {state['epochs'] - 1} could not be committed")
        remove(self.spark, f"{self.path}/commits/{state['epochs'] - 2:012d}")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int").alias("bucket")

    def step(self, batch: DataFrame, epoch: int) -> None:
        """Takes one epoch of rows (keys..., event_time, row) into the store and commits it."""
        was = self.state()
        if epoch < was["epochs"]:
            return
        read = self.spark.read
        known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))
        one = batch.where(known).groupBy(*self.keys).agg(F.count("*").alias("n"), F.max("event_time").alias("last_time"), F.min("row").alias("row"))
        live = read.schema(f"{self.key_schema}, last_time timestamp").parquet(was["live"]).select(*self.keys, "last_time") if was["live"] else None
        in_live = in_archive = F.lit(False)
        if live is not None:
            one = one.join(live.select(*self.keys, F.lit(True).alias("in_live")), self.keys, "left")
            in_live = F.col("in_live").isNotNull()
        if was["archive"]:
            # the late-arrival lookup: only what the live store does not know finds anything
            old = reduce(DataFrame.unionByName, (read.schema(f"{self.key_schema}, bucket int").parquet(p) for _, p in was["archive"]))
            one = one.withColumn("bucket", F.when(~in_live, self._bucket())).join(old.withColumn("in_archive", F.lit(True)), [*self.keys, "bucket"], "left")
            in_archive = F.col("in_archive").isNotNull()
        seen = Observation()
        path = f"{self.path}/rows/epoch={epoch}"
        one = one.select(*self.keys, "n", "last_time", "row", (in_live | in_archive).alias("seen"), in_archive.alias("archived"))
        one.observe(seen, F.max(F.unix_micros(F.col("last_time") - F.expr(f"interval {self.delay}"))).alias("mark")).write.mode("overwrite").parquet(path)
        mark = max((m for m in (was["watermark"], seen.get["mark"]) if m is not None), default=None)
        state = read.schema(f"{self.key_schema}, last_time timestamp, archived boolean").parquet(path).where("not archived").select(*self.keys, "last_time")
        if live is not None:
            state = state.unionByName(live).groupBy(*self.keys).agg(F.max("last_time").alias("last_time"))
        expired = F.coalesce(F.col("last_time") < F.timestamp_micros(F.lit(mark)), F.lit(True)) if mark is not None else F.lit(False)
        part = f"{self.path}/state/epoch={epoch}"
        state.withColumn("expired", expired).withColumn("bucket", F.when(F.col("expired"), self._bucket()).otherwise(-1)).write.mode("overwrite").partitionBy("expired").parquet(part)
        now = {"epochs": epoch + 1, "watermark": mark, "live": f"{part}/expired=false" if self.exists(f"{part}/expired=false") else None, "archive": [*was["archive"]]}
        if self.exists(f"{part}/expired=true"):
            now["archive"].append([0, f"{part}/expired=true"])
        dropped = self._merge(now, epoch)
        self._commit(now)
        for p in [*dropped, *([was["live"]] if was["live"] else [])]:  # no commit that can be read again names these
            remove(self.spark, p)

    def _merge(self, now: dict, epoch: int) -> list[str]:
        """Makes one of MERGED archive parts of the same level; the parts that are then no longer named."""
        dropped: list[str] = []
        while True:
            levels = [level for level, _ in now["archive"]]
            full = [x for x in sorted(set(levels)) if levels.count(x) >= MERGED]
            if not full:
                return dropped
            parts = [p for level, p in now["archive"] if level == full[0]]
            path = f"{self.path}/archive/epoch={epoch}-level={full[0] + 1}"
            old = (self.spark.read.schema(f"{self.key_schema}, bucket int").parquet(p) for p in parts)
            reduce(DataFrame.unionByName, old).repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(path)
            now["archive"] = [x for x in now["archive"] if x[0] != full[0]] + [[full[0] + 1, path]]
            dropped += parts

    def replay(self, batch: DataFrame, number: int, slices: int) -> None:
        """Takes one micro-batch in as so many epochs, in order of the column ``arrived``; equal times stay together."""
        path = f"{self.path}/landed/batch={number}"
        if not self.exists(f"{path}/_SUCCESS"):
            at = F.unix_micros("arrived")
            bounds = batch.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 1000)).first()[0] or []
            part = reduce(lambda a, b: a + b, (F.coalesce((at > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
            batch.withColumn("slice", part).drop("arrived").write.mode("overwrite").partitionBy("slice").parquet(path)
        landed = self.spark.read.schema(batch.drop("arrived").schema.add("slice", "integer")).parquet(path)
        for k in range(slices):
            self.step(landed.where(F.col("slice") == k).drop("slice"), number * slices + k)
        remove(self.spark, f"{self.path}/landed/batch={number - 1}")


def run(
    spark: SparkSession,
    source: str,
    keys: list[str],
    event_time: str,
    received: list[str],
    payload: list[str] | None = None,
    *,
    path: str | None = None,
    delay: str = EXPECTED_DELAY,
    files_per_batch: int | None = None,
    slices: int = 1,
) -> Delivered:
    """Streams the parquet files at ``source`` through the store until all are taken in, and returns what is committed.

    ``received`` orders the copies of an identifier; ``payload`` are the other columns of kept rows. With ``slices``
    above 1 every micro-batch becomes so many epochs by the first of ``received``. Run again with the same ``path``,
    it goes on where it stopped.
    """
    path = path or new_dir(spark, "exactly-once")
    given = spark.read.parquet(source).schema
    payload = [c for c in payload or [] if c not in keys]
    order = [c for c in received if c not in keys]
    rest = [c for c in payload if c not in order]
    ddl = lambda names: ", ".join(f"`{n}` {given[n].dataType.simpleString()}" for n in names)
    rows = spark.readStream.schema(given)
    rows = rows.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else rows
    as_time = lambda c: F.col(c) if given[c].dataType.simpleString() == "timestamp" else F.col(c).try_cast("timestamp")
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    # a stream's base path must be a folder; a pattern that matches the one file has none
    names = [*keys, as_time(event_time).alias("event_time"), F.struct(*order, *keys, *rest).alias("row")]
    narrow = rows.parquet(f"{source[:-1]}[{source[-1]}]" if single else source).select(*names, *([as_time(received[0]).alias("arrived")] if slices > 1 else []))
    store = SeenStore(spark, path, keys, ddl(keys), delay)
    take = (lambda df, n: store.replay(df, n, slices)) if slices > 1 else store.step
    query = narrow.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return Delivered(spark, path, store.committed(), ddl([*order, *keys, *rest]), ddl(keys))


def raw_observations(spark: SparkSession, d: str, payload: list[str] | None = None, **kw) -> Delivered:
    return run(spark, f"{d}/raw_observations.parquet", ["obs_id"], "ts", ["received_at", "batch_id"], ["session_id", *(payload or [])], **{"slices": SLICES} | kw)


def transcript_rows(spark: SparkSession, d: str, payload: list[str] | None = None, **kw) -> Delivered:
    return run(spark, f"{d}/transcript_rows.parquet", ["session_id", "uuid"], "received_at", ["received_at", "batch_id"], payload, **{"slices": SLICES} | kw)


def _named(df: DataFrame, name: str, record: str, *more: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "session_id", F.col(record).alias("record_id"), *more)


def _both(spark: SparkSession, d: str, payload: dict[str, list[str]]) -> list[Delivered]:
    """Both tables, taken in side by side."""
    with ThreadPoolExecutor(2) as pool:
        return [x.result() for x in [pool.submit(f, spark, d, payload.get(f.__name__)) for f in (raw_observations, transcript_rows)]]


def redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers with more than one row: (table_name, session_id, record_id)."""
    obs, rows = _both(spark, d, {})
    twice = obs.kept.join(obs.suppressed.select("obs_id").distinct(), "obs_id", "left_semi")
    return _named(twice, "raw_observations", "obs_id").unionByName(_named(rows.suppressed.select("session_id", "uuid").distinct(), "transcript_rows", "uuid"))


#: what of a kept row goes into p7_kept besides its identifier and delivery
PAYLOAD = {"raw_observations": ["tool_name", "tool_input", "tool_output", "user_prompt", "assistant_response"], "transcript_rows": ["row_type", "ts", "message_role"]}


def kept_once(spark: SparkSession, d: str) -> DataFrame:
    """The one row kept of every identifier, with its payload as one text."""
    out = []
    for name, got, record in zip(PAYLOAD, _both(spark, d, PAYLOAD), ("obs_id", "uuid")):
        body = F.concat_ws("\u0001", *(F.coalesce(F.col(c), F.lit("")) for c in PAYLOAD[name])).alias("payload")
        out.append(_named(got.kept, name, record, "received_at", "batch_id", body))
    return out[0].unionByName(out[1])
