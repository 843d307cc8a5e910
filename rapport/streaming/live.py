"""Live views of a ledger stream: deduplication, lateness, counters and late media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.functions.dates import days_ago, ntz
from rapport.operators.ledger import has_person, status_columns
from rapport.sinks.changes import latest
from rapport.sinks.tables import Archive


def without_repeats(stream: DataFrame, key: str = "path", at: str = "seen_at", within: str = "1 second") -> DataFrame:
    """Repeated notifications of one file within a short time count once."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def split_future(rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows up to the clock, future-dated rows). The latter stay in lifetime counts."""
    future = F.coalesce(F.col("occurred_at") > ntz(as_of), F.lit(False))     # without a time: not future
    return rows.where(~future), rows.where(future)


def activity_windows(stream: DataFrame, width: str = "14 days", slide: str = "1 day",
                     lateness: str = "1 day") -> DataFrame:
    """Sliding counts per person with bounded lateness. The aggregate is Spark's own,
    so a busy person is combined on every task before the shuffle."""
    return (timed(stream.where(has_person(F.col("person_id"))), "occurred_at").withWatermark("occurred_at", lateness)
            .groupBy("person_id", F.window("occurred_at", width, slide).alias("w"))
            .agg(F.count("*").alias("n"))
            .select("person_id", F.col("w.end").alias("window_end"), "n"))


def timed(stream: DataFrame, at: str) -> DataFrame:
    """Watermarks take TIMESTAMP only; the ledger holds wall-clock times, read as UTC."""
    if stream.schema[at].dataType.typeName() == "timestamp_ntz":
        return stream.withColumn(at, F.col(at).cast("timestamp"))
    return stream


def daily_counts(rows: DataFrame) -> DataFrame:
    """(person, day) counts of a micro-batch: additive buckets. There is no state and
    no watermark, so rows of any age count, and a future-dated row makes nothing late."""
    day = F.date_trunc("day", F.col("occurred_at").cast("timestamp_ntz")).cast("timestamp_ntz")
    return (rows.where(has_person(F.col("person_id")) & F.col("occurred_at").isNotNull())
            .groupBy("person_id", day.alias("day")).agg(F.count("*").alias("n")))


def status_from_days(daily: DataFrame, as_of, rules: str = "classic") -> DataFrame:
    """Status per person from day buckets (windows are whole days). Evaluated at any
    ``as_of``, so people without new events decay as time passes."""
    now, day = ntz(as_of), F.col("day")
    rows = daily.where(day <= now).groupBy("person_id").agg(
        F.sum("n").alias("interactions"), F.max("day").alias("last_at"),
        F.coalesce(F.sum(F.when(day >= days_ago(now, 14), F.col("n"))), F.lit(0)).alias("n14"),
        F.coalesce(F.sum(F.when(day >= days_ago(now, 60), F.col("n"))), F.lit(0)).alias("n60"))
    status, reason = status_columns(F.col("n14"), F.col("n60"), F.col("last_at"), as_of, rules)
    return rows.withColumns({"status": status, "reason": reason})


def status_changes(archive: Archive, as_of, rules: str = "classic"):
    """``foreachBatch`` handler for a stream of ledger rows: stores the batch's day
    buckets, and publishes a row for everybody whose status became another. A replayed
    batch overwrites its own buckets. ``as_of`` is a time, or a function that gives the
    time of a batch; between batches nothing decays (:mod:`rapport.streaming.decay`
    has timers for that)."""
    def handle(rows: DataFrame, batch: int) -> None:
        now = as_of() if callable(as_of) else as_of
        archive.write("daily", daily_counts(rows).withColumn("version", F.lit(batch)), batch)
        current = status_from_days(archive.read("daily"), now, rules).select("person_id", "status", "reason")
        known = latest(archive.read("statuses", before=batch), ["person_id"], "version").select(
            "person_id", F.col("status").alias("was"))
        changed = current.join(known, "person_id", "left").where(~F.col("status").eqNullSafe(F.col("was")))
        written = archive.write("statuses", changed.withColumn("version", F.lit(batch)), batch)
        archive.write("live_feed", written.select(F.lit("status").alias("topic"), F.col("person_id").alias("key"),
                                             F.col("status").alias("detail")), batch)

    return handle


def media_with_messages(references: DataFrame, media: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Stream-stream join of attachment references (message_id, filename_key,
    sent_at) with media (media_id, filename_key, arrived_at): whichever comes first
    waits for the other within the lateness; what comes later is linked by the batch
    reconciliation."""
    left = timed(references, "sent_at").withWatermark("sent_at", lateness).alias("r")
    right = timed(media, "arrived_at").withWatermark("arrived_at", lateness).alias("m")
    near = (F.col("r.filename_key") == F.col("m.filename_key")) & (
        F.col("m.arrived_at") >= F.col("r.sent_at") - F.expr(f"interval {lateness}")) & (
        F.col("m.arrived_at") <= F.col("r.sent_at") + F.expr(f"interval {lateness}"))
    return left.join(right, near, "left_outer").select(
        "r.message_id", "r.filename_key", "r.sent_at", "m.media_id")
