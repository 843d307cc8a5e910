"""Archive tables as parquet folders, one partition per import batch.

A replayed batch overwrites its own partition and reads only the partitions before
it, so writing is idempotent; rows are never updated in place.

An import writes many tables; they become visible together. Readers see batches up to
the last committed one, the import itself also the batch it is writing. Tables with
times are parted by month below the batch and ordered by person inside their files, so
a time window reads its months, and one person's rows a few row groups.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport.functions.dates import ntz
from rapport.schemas import DATED, IMPORTED, KEYS, SLOTS, SLOTTED, TABLES
from rapport.sinks.changes import latest, new_rows


def slot_of(person: Column) -> Column:
    return F.pmod(F.xxhash64(person), F.lit(SLOTS)).cast("int")


class Archive:
    """Tables under ``root``, a folder every executor can reach. ``at`` pins what is read to a commit, so that several
    tables belong together whatever is imported meanwhile."""

    def __init__(self, spark: SparkSession, root: str, at: int | None = None):
        self.spark, self.root, self.at = spark, root.rstrip("/"), at

    def _stored(self, name: str) -> DataFrame:
        part = ", month string" if name in DATED else ", slot int" if name in SLOTTED else ""
        schema = TABLES[name] + ", batch bigint" + part
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _load(self, name: str) -> DataFrame:
        rows = self._stored(name)
        if name in IMPORTED:
            rows = rows.where(F.col("batch") <= (self.committed() if self.at is None else self.at))
        return rows

    def committed(self) -> int:
        """The last batch whose tables are all written, -1 before the first."""
        return self._stored("commits").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first().b

    def snapshot(self) -> Archive:
        """The archive as of its last commit."""
        return Archive(self.spark, self.root, self.committed())

    def writing(self, batch: int) -> Archive:
        """The archive as the import of ``batch`` sees it."""
        return Archive(self.spark, self.root, batch)

    def commit(self, batch: int) -> None:
        """Make a batch visible. It is the last thing that an import writes."""
        self.write("commits", self.spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").alias("at")), batch)

    def rows(self, name: str) -> DataFrame:
        """All rows with the number of the batch that wrote them."""
        return self._load(name).drop("month", "slot")

    def has(self, name: str) -> bool:
        """Whether anything was written to a table."""
        try:
            self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return False
        return True

    def last_batch(self, name: str) -> int:
        """The last batch of a table, -1 without any."""
        return self._load(name).agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first().b

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before one (partitions are pruned)."""
        rows = self._load(name)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch", "month", "slot")

    def window(self, name: str, since, until) -> DataFrame:
        """Rows with ``since <= time <= until``; only their months are read."""
        at, month = F.col(DATED[name]), lambda t: F.date_format(ntz(t), "yyyy-MM")
        return (self._load(name).where(F.col("month").between(month(since), month(until)))
                .where((at >= ntz(since)) & (at <= ntz(until))).drop("batch", "month", "slot"))

    def since(self, name: str, since) -> DataFrame:
        """Rows from a moment on; earlier months are not read."""
        at = ntz(since)
        return (self._load(name).where(F.col("month") >= F.date_format(at, "yyyy-MM"))
                .where(F.col(DATED[name]) >= at).drop("batch", "month"))

    def of_slots(self, name: str, slots: list[int]) -> DataFrame:
        """Rows in some of a slotted table's parts; the others are not read."""
        return self._load(name).where(F.col("slot").isin(slots)).drop("batch", "slot")

    def batch(self, name: str, batch: int) -> DataFrame:
        return self._stored(name).where(F.col("batch") == batch).drop("batch", "month", "slot")

    def write(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write one batch and hand back what was written, its lineage cut."""
        columns = [f.strip().split(" ")[0] for f in split_ddl(TABLES[name])]
        for column in columns:
            if column not in rows.columns:
                rows = rows.withColumn(column, F.lit(None))
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        out = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])
        path = f"{self.root}/{name}/batch={batch}"
        if name in DATED:
            month = F.coalesce(F.date_format(DATED[name], "yyyy-MM"), F.lit("none"))
            order = [c for c in ("month", "person_id") if c == "month" or c in columns]
            # Rebalancing splits a month with very many rows and keeps few rows in few files.
            out.withColumn("month", month).hint("rebalance", "month").sortWithinPartitions(*order).write.partitionBy("month").mode("overwrite").parquet(path)
        elif name in SLOTTED:
            out = out.withColumn("slot", slot_of(F.col("person_id"))).hint("rebalance", "slot")
            out.sortWithinPartitions("slot", "person_id").write.partitionBy("slot").mode("overwrite").parquet(path)
        else:
            out.write.mode("overwrite").parquet(path)
        return self.batch(name, batch)

    def stage(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """Keep an intermediate result of a batch as a table and read it back, so
        later steps start from files instead of a long plan."""
        path = f"{self.root}/_staging/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def insert_new(self, name: str, rows: DataFrame, batch: int, order: list[str]) -> DataFrame:
        """Insert-if-new by the table's key; first write wins."""
        key = KEYS[name]
        return self.write(name, new_rows(rows, self.read(name, before=batch), [key], order), batch)

    def latest(self, name: str, key: list[str], before: int | None = None) -> DataFrame:
        """Upsert view: the row of the last batch that wrote the key."""
        rows = self._load(name)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return latest(rows.drop("month", "slot"), key, "batch").drop("batch")


def split_ddl(ddl: str) -> list[str]:
    """Top-level column definitions of a DDL string."""
    out, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return out + [current]
