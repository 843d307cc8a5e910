"""Row-level write semantics expressed on DataFrames.

Parquet has no MERGE, so every change is either appended (inserts, versions,
tombstones) or read through a view that resolves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.operators.ranking import first_per_group


def new_rows(batch: DataFrame, target: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Insert-if-new: one row per key (the first by ``order``), and only keys the
    target does not hold yet. Rows whose key is NULL never collide."""
    first = first_per_group(batch, key, order)
    keyless = batch.where(_any_null(key))
    keyed = first.where(~_any_null(key))
    fresh = keyed if target is None else keyed.join(target.select(*key), key, "left_anti")
    return fresh.select(*batch.columns).unionByName(keyless)


def _any_null(key: list[str]):
    missing = F.lit(False)
    for column in key:
        missing = missing | F.col(column).isNull()
    return missing


def insert_counts(batch: DataFrame, target: DataFrame | None, key: list[str]) -> DataFrame:
    """(inserted, skipped) an insert-if-new of ``batch`` comes to, in one pass."""
    seen = batch.groupBy(*key).agg(F.count("*").alias("n"))
    if target is None:
        marked = seen.withColumn("known", F.lit(False))
    else:
        known = target.select(*key).distinct().withColumn("known", F.lit(True))
        marked = seen.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    inserted = F.coalesce(F.sum(F.when(~F.col("known"), 1).otherwise(0)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return marked.agg(inserted.cast("bigint").alias("inserted"), (total - inserted).cast("bigint").alias("skipped"))


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert view: the last written version of every key."""
    return first_per_group(versions, key, [version], desc=True)


def set_fields(df: DataFrame, updates: DataFrame, key: list[str], mark: str | None = None) -> DataFrame:
    """Partial update: columns of ``updates`` replace those of ``df`` where the key
    matches. ``mark`` adds a flag that is true only for rows that really changed."""
    fields = [c for c in updates.columns if c not in key]
    side = updates.withColumnsRenamed({c: f"_new_{c}" for c in fields}).withColumn("_hit", F.lit(True))
    out = df.join(side, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    if mark:
        out = out.withColumn(mark, hit & changed)
    out = out.withColumns({c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields})
    return out.select(*df.columns, *([mark] if mark else []))


def without_deleted(df: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    """Delete view: rows whose key carries a tombstone are gone."""
    return df.join(tombstones.select(*key), key, "left_anti")


def unprocessed(files: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Files whose content (SHA-256) was not processed before; copies inside the
    batch count once, under their first path."""
    marked = files if "checksum" in files.columns else files.withColumn("checksum", F.sha2("content", 256))
    firsts = marked.groupBy("checksum").agg(F.min("path").alias("path"))
    fresh = firsts if ledger is None else firsts.join(ledger.select("checksum"), "checksum", "left_anti")
    return marked.join(fresh, ["checksum", "path"], "left_semi")


def job_states(job_events: DataFrame) -> DataFrame:
    """Latest state of every import job from its append-only event table."""
    return latest(job_events, ["id"], "version")


def resumed(states: DataFrame) -> DataFrame:
    """Jobs interrupted while PROCESSING go back to QUEUED."""
    return states.withColumn("status", F.when(F.col("status") == "PROCESSING", "QUEUED").otherwise(F.col("status")))


def provenance(records: DataFrame) -> DataFrame:
    """(checksum, filename, record_count) per imported file."""
    return records.groupBy("checksum", "filename").agg(F.count("*").alias("record_count"))
