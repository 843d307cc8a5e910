"""Top-n, first-row and position operators that hold when one key owns a large
share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank.

    ``row_number() <= n`` lets Spark cut every map task to n rows per key before
    the shuffle, so a hot key sends n rows per task and no more.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_group(df: DataFrame, keys: list[str], order: list[str], desc: bool = False) -> DataFrame:
    """One whole row per group, the first (or last) by ``order``, then by a hash of
    the other plain columns, so equal orders do not leave it to chance: an aggregate
    with map-side combine, not a sort."""
    pick = F.max_by if desc else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    plain = [f.name for f in df.schema if f.name in rest and f.name not in order
             and f.dataType.typeName() in ("string", "long", "integer", "timestamp", "timestamp_ntz", "boolean", "double")]
    by = F.struct(*[F.col(c) for c in order], F.xxhash64(F.lit(0), *[F.col(c) for c in plain]).alias("_tie"))
    picked = df.groupBy(*keys).agg(pick(row, by).alias("_row"))
    return picked.select(*[F.col(k) for k in keys], "_row.*").select(*df.columns)


def positions(df: DataFrame, keys: list[str], at: str, ties: list[str],
              name: str = "position", bucket: str = "hour") -> DataFrame:
    """1-based position of every row inside its group, in time order.

    Groups are unbounded, so they are numbered in two levels: rows inside a time
    bucket are ranked on their own, and the rows of earlier buckets are added
    from the (small) table of bucket counts. No task sorts a whole group.
    """
    part = F.coalesce(F.date_trunc(bucket, F.col(at)).cast("timestamp_ntz"),
                      F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    marked = df.withColumn("_bucket", part)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(at).asc_nulls_first(), *ties)
    ranked = marked.withColumn("_inside", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop(
        "_bucket", "_before", "_inside")


def rolling_counts(df: DataFrame, keys: list[str], at: str, days: list[int], bucket: int = 3600) -> DataFrame:
    """For every row, how many rows of its group lie in the n days up to its time, both ends included.

    A count is the difference of two running counts: up to the row's time, and up to just before the window. Equal
    times are folded first; both points are then ranked inside a bucket of some seconds and the rows of earlier buckets
    are added, as in :func:`positions`. No task holds more of a group than one bucket, however long the windows are.
    Rows without a time have no window and keep NULL counts; a NULL key is a group.
    """
    # The keys meet as one struct, which is never NULL itself, so joins need no null-safe form.
    marked = df.withColumns({"_group": F.struct(*keys), "_at": F.unix_micros(F.col(at).cast("timestamp"))})
    points = marked.where(F.col("_at").isNotNull()).groupBy("_group", "_at").agg(F.count("*").alias("_n"))
    nothing = F.lit(0).cast("bigint")
    marks = F.array(F.struct(nothing.alias("window"), F.col("_at").alias("point"), F.col("_n").alias("n")), *[
        F.struct(F.lit(n).cast("bigint").alias("window"), (F.col("_at") - n * 86400 * 1_000_000 - 1).alias("point"),
                 nothing.alias("n")) for n in days])
    sweep = (points.select("_group", "_at", F.inline(marks))
             .withColumn("_bucket", F.expr(f"point div {bucket * 1_000_000} - int(point < 0)")))
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sweep.groupBy("_group", "_bucket").agg(F.sum("n").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), nothing)).drop("_n"))
    inside = Window.partitionBy("_group", "_bucket").orderBy("point").rangeBetween(Window.unboundedPreceding, 0)
    ranked = sweep.withColumn("_inside", F.sum("n").over(inside)).join(offsets, ["_group", "_bucket"])
    until = lambda n: F.max(F.when(F.col("window") == n, F.col("_before") + F.col("_inside")))
    counts = ranked.groupBy("_group", "_at").agg(*[(until(0) - until(n)).alias(f"n{n}") for n in days])
    return marked.join(counts, ["_group", "_at"], "left").select(*df.columns, *[f"n{n}" for n in days])


def sorted_page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Multi-key sort with optional offset and limit; end ``order`` in a unique key."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
