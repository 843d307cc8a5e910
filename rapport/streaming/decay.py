"""Statuses that change as time passes: counts of moving windows, kept per person with timers.

A person's state is a map from bucket (a day) to count, never longer than the long window and what lies in the future, and
the sum of older buckets. Every change of a count has a known time: a bucket enters when its time comes (rows dated ahead
wait for it), leaves the short window, leaves the long one, or the last contact becomes so and so many days old. A timer is
set for the next of these, so somebody's status changes without any new row.

Rows are added up by person and bucket in the tasks that read them, before they are dealt by person: a busy person sends a
row per task and day, whatever their share of the stream.

The operator needs Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rapport.operators.ledger import has_person, status_columns
from rapport.operators.ranking import first_per_group
from rapport.sinks.changes import latest
from rapport.sinks.tables import Archive

DAY = 86_400
COUNTS = "person_id string, interactions bigint, n14 bigint, n60 bigint, last_bucket bigint, as_of_ms bigint"
ROCKS = "RocksDBStateStoreProvider"
#: Ages of the last contact, in buckets, at which the ladders of ``status_columns`` change their answer.
MARKS = (31, 46)


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by person and bucket of one task."""
    total = None
    for frame in frames:
        part = frame.groupby(["person_id", "bucket"])["n"].sum()
        total = part if total is None else total.add(part, fill_value=0)
    if total is not None:
        yield total.astype("int64").rename("n").reset_index()


def bucketed(stream: DataFrame, width: int = DAY) -> DataFrame:
    """(person_id, bucket, n) of a stream of ledger rows, partly added up; ``width`` is in seconds."""
    at = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    rows = stream.where(has_person(F.col("person_id")) & F.col("occurred_at").isNotNull()).select(
        "person_id", F.floor(at / F.lit(width * 1_000_000)).cast("bigint").alias("bucket"), F.lit(1).cast("bigint").alias("n"))
    return rows.mapInPandas(_added, "person_id string, bucket bigint, n bigint")


class MovingCounts(StatefulProcessor):
    """Counts of the last ``short`` and ``long`` buckets of a person, given out whenever they or the person's rest change."""

    def __init__(self, width: int = DAY, short: int = 14, long: int = 60):
        self.width, self.short, self.long = width * 1_000, short, long

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "n bigint")
        self.older = handle.getValueState("older", "n bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for frame in rows:
            for bucket, n in zip(frame["bucket"], frame["n"]):
                new[int(bucket)] = new.get(int(bucket), 0) + int(n)
        for bucket, n in new.items():
            known = self.buckets.getValue((bucket,)) if self.buckets.containsKey((bucket,)) else None
            self.buckets.updateValue((bucket,), (n + (known[0] if known else 0),))
        yield self._counted(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._counted(key, timerValues.getCurrentProcessingTimeInMs())

    def _counted(self, key, now: int) -> pd.DataFrame:
        width, held = self.width, {k[0]: v[0] for k, v in self.buckets.iterator()}
        n, last = self.older.get() if self.older.exists() else (0, None)
        gone = [b for b in held if b * width < now - self.long * width]
        for b in gone:
            n, last = n + held.pop(b), b if last is None else max(b, last)
            self.buckets.removeKey((b,))
        if gone:
            self.older.update((n, last))
        past = {b: c for b, c in held.items() if b * width <= now}
        last = max([*past, *([] if last is None else [last])], default=None)
        inside = lambda most: sum(c for b, c in past.items() if b * width >= now - most * width)
        # A bucket is inside up to its age of ``most`` buckets, and outside a millisecond later.
        ahead = [b * width + most * width + 1 for b in past for most in (self.short, self.long)]
        ahead += [b * width for b in held if b not in past]
        ahead += [(last + mark) * width for mark in MARKS] if last is not None else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        coming = min((t for t in ahead if t > now), default=None)
        if coming is not None:
            self.handle.registerTimer(coming)
        return pd.DataFrame({"person_id": [key[0]], "interactions": [n + sum(past.values())], "n14": [inside(self.short)],
                             "n60": [inside(self.long)], "last_bucket": pd.array([last], "Int64"), "as_of_ms": [now]})

    def close(self) -> None:
        pass


def live_statuses(stream: DataFrame, rules: str = "classic", width: int = DAY, short: int = 14, long: int = 60) -> DataFrame:
    """person_id, interactions, n14, n60, last_at, as_of, status, reason: a row whenever time or new rows change a person.

    Equal to ``status_from_days`` at each row's ``as_of``. Somebody with future rows only has no contact yet.
    """
    provider = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not provider.endswith(ROCKS):
        raise ValueError(f"live statuses keep timers: set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    counts = bucketed(stream, width).groupBy("person_id").transformWithStateInPandas(
        statefulProcessor=MovingCounts(width, short, long), outputStructType=COUNTS, outputMode="Update", timeMode="ProcessingTime")
    ntz = lambda c: c.cast("timestamp_ntz")
    rows = counts.withColumns({"last_at": ntz(F.timestamp_seconds(F.col("last_bucket") * width)),
                               "as_of": ntz(F.timestamp_millis("as_of_ms"))}).drop("last_bucket", "as_of_ms")
    status, reason = status_columns(F.col("n14"), F.col("n60"), F.col("last_at"), F.col("as_of"), rules)
    return rows.withColumns({"status": status, "reason": reason})


def status_feed(archive: Archive):
    """``foreachBatch`` handler for :func:`live_statuses`: publishes people whose status became another.

    Only the published statuses of the batch's people are looked up; a replayed batch overwrites its own rows."""
    def handle(rows: DataFrame, batch: int) -> None:
        now = archive.stage("live", first_per_group(rows, ["person_id"], ["as_of"], desc=True), batch)
        mine = archive.rows("statuses").where(F.col("batch") < batch).join(now.select("person_id"), "person_id", "left_semi")
        known = latest(mine, ["person_id"], "version").select("person_id", F.col("status").alias("was"))
        changed = now.join(known, "person_id", "left").where(~F.col("status").eqNullSafe(F.col("was")))
        written = archive.write("statuses", changed.withColumn("version", F.lit(batch)), batch)
        archive.write("live_feed", written.select(F.lit("status").alias("topic"), F.col("person_id").alias("key"),
                                             F.col("status").alias("detail")), batch)

    return handle
