"""Incremental forms: keyed upsert by micro-batch, first-key dedup, and a stateful health fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.durable import durable
from ..operators.snapshots import files, versions_of
from ..operators.health import RECOVERABLE
from ..operators.publish import archive_partition, write_archive


def first_by_key(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def latest_by_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key of a batch, the latest."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The version in which each bucket was last written: one small row for a bucket."""
    rows = spark.read.schema("bucket int, written long").parquet(f"{path}/versions/v={version}").collect()
    return dict(map(tuple, rows))


def _read(spark: SparkSession, path: str, buckets: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/rows/v={v}/bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.parquet(*paths) if paths else None


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of an upserted store."""
    return _read(spark, path, _manifest(spark, path, versions_of(spark, path)[-1]))


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes all versions but the two latest, and the buckets that only they refer to; what is left stays of bounded size."""
    numbers = versions_of(spark, path)
    old, kept = numbers[:-2], numbers[-2:]
    if not old:
        return
    used = {x for n in kept for x in _manifest(spark, path, n).items()}
    for n in old:
        gone = {(b, v) for b, v in _manifest(spark, path, n).items()} - used
        for name in [*(f"rows/v={v}/bucket={b}" for b, v in gone), f"versions/v={n}"]:
            system, folder = files(spark, f"{path}/{name}")
            system.delete(folder, True)


def _publish(spark: SparkSession, path: str, number: int, known: dict[int, int], rows: DataFrame, touched: set[int], bucket: Column) -> None:
    """Writes the touched buckets as version ``number``, then its manifest, which makes it the latest."""
    rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={number}")
    system, folder = files(spark, f"{path}/rows/v={number}")
    there = {int(s.getPath().getName()[7:]) for s in system.listStatus(folder) if s.getPath().getName().startswith("bucket=")}
    now = {b: v for b, v in known.items() if b not in touched} | dict.fromkeys(there, number)
    manifest = spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, written long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={number}")
    _forget(spark, path)


def take_out(spark: SparkSession, path: str, keys: list[str], leaves: Column, buckets: int = 16) -> DataFrame:
    """Removes the rows for which ``leaves`` holds from an upserted store and returns them, written: only their buckets are rewritten.

    Archive what is returned before the next change of the store, whose buckets before and after are both kept until then.
    """
    numbers, bucket = versions_of(spark, path), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    known = _manifest(spark, path, numbers[-1])
    gone = durable(stored(spark, path).where(leaves))
    touched = {r[0] for r in gone.select(bucket.alias("b")).distinct().collect()}
    if touched:
        rest = _read(spark, path, {b: v for b, v in known.items() if b in touched}).where(~F.coalesce(leaves, F.lit(False)))
        _publish(spark, path, numbers[-1] + 1, known, rest, touched, bucket)
    return gone


def upsert_stream(stream: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, buckets: int = 16, first: int = 0) -> StreamingQuery:
    """Runs ``merge(store, batch)`` for each micro-batch and publishes a new version of the store at ``path``; :func:`stored` reads it.

    Rows lie in ``buckets`` by hash of ``keys``; a micro-batch reads and rewrites only the buckets it touches.  Versions are numbered by
    batch from ``first`` on, so a replayed batch writes the same version again; a version is complete or absent.  Older ones are deleted.
    After :func:`take_out` or with a new checkpoint, ``first`` has to lie above the latest version less the batches already counted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        number += first
        earlier = [v for v in versions_of(spark, path) if v < number]
        known = _manifest(spark, path, earlier[-1]) if earlier else {}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}
        if not touched and known:
            return
        old = _read(spark, path, {b: v for b, v in known.items() if b in touched})
        _publish(spark, path, number, known, merge(old, batch), touched, bucket)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def move_to_archive(spark: SparkSession, path: str, keys: list[str], archive: str, now: Column, days: int, buckets: int = 16) -> int:
    """Rows of an upserted store that closed more than ``days`` ago are merged into the archive and then leave the store; how many.

    They are archived first: if the job ends between the two, the next run finds them in both places and merges them again.
    """
    old = durable(archive_partition(stored(spark, path), now, days).drop("partition"))
    count = old.count()
    if count:
        write_archive(old, archive)
        take_out(spark, path, keys, F.coalesce(F.col("closing_at") < now - F.make_dt_interval(F.lit(days)), F.lit(False)), buckets)
    return count


_STATE = "status string, failures int, nonzero int"


def health_stream(runs: DataFrame, source: str = "source", at: str = "run_at") -> DataFrame:
    """(source, status, runs): the status fold of :mod:`noticeloom.operators.health`, kept as state per source."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failures, nonzero = state.get if state.exists else ("EXPERIMENTAL", 0, 0)
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        for ok, discovered, captcha in zip(rows["ok"], rows["discovered"], rows["captcha"], strict=True):
            good = bool(ok) and discovered > 0
            failures = 0 if good else failures + 1
            degraded = (ok and discovered == 0 and nonzero >= 3) or (not ok and failures >= 2)
            nonzero += good
            if captcha:
                status = "CAPTCHA_LIMITED"
            elif degraded:
                status = "DEGRADED"
            elif good:
                status = "ACTIVE" if status in RECOVERABLE else status
            elif not ok:
                status = "TEMPORARILY_BROKEN"
        state.update((status, int(failures), int(nonzero)))
        yield pd.DataFrame({source: [key[0]], "status": [status], "runs": [len(rows)]})

    return runs.groupBy(source).applyInPandasWithState(fold, f"{source} string, status string, runs int", _STATE, "update", GroupStateTimeout.NoTimeout)


class _Expiring(StatefulProcessor):
    """Keeps the latest row of a key and emits it once event time is ``keep_ms`` past it."""

    def __init__(self, columns: list[str], schema: str, at: str, keep_ms: int):
        self.columns, self.schema, self.at, self.keep_ms = columns, schema, at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", f"{self.schema}, expires_ms_ bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        row = frame.iloc[-1]
        expires = int(pd.Timestamp(row[self.at]).timestamp() * 1000) + self.keep_ms
        held = self.latest.get() if self.latest.exists() else None
        if held is None or held[-1] <= expires:
            if held is not None:
                self.handle.deleteTimer(held[-1])
            self.latest.update((*(None if pd.isna(row[c]) else row[c].to_pydatetime() if isinstance(row[c], pd.Timestamp) else getattr(row[c], "item", lambda v=row[c]: v)() for c in self.columns), expires))
            self.handle.registerTimer(expires)
        yield from ()  # nothing leaves before its time

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.latest.get()
        self.latest.clear()
        yield pd.DataFrame([dict(zip(self.columns, held[:-1], strict=True))])

    def close(self) -> None:
        pass


def expired(stream: DataFrame, keys: list[str], at: str, days: int, delay: str = "1 day") -> DataFrame:
    """The latest row of each key, once ``days`` have passed in event time without a later one: what goes to the archive.

    A key's state is one row, and it goes when the row is emitted.  Columns are plain values; ``at`` becomes a timestamp.  Needs the RocksDB state store.
    """
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    processor = _Expiring(rows.columns, schema, at, days * 86_400_000)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
