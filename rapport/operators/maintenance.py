"""Schema upkeep, re-indexing and a demo corpus of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rapport.operators.retrieval import write_index


def upgrade(df: DataFrame, ddl: str, fills: dict[str, Column] | None = None) -> DataFrame:
    """Old rows in the current schema: missing columns added (back-filled from
    ``fills`` where given), others cast, columns the schema does not know dropped."""
    target = _schema(df.sparkSession, ddl)
    fills = fills or {}
    return df.select(*[
        (F.coalesce(F.col(f.name), fills[f.name]) if f.name in df.columns and f.name in fills
         else F.col(f.name) if f.name in df.columns
         else fills.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target.fields])


def upgrade_report(df: DataFrame, ddl: str) -> DataFrame:
    """(column, change) with change in added / rebuilt / dropped."""
    target = _schema(df.sparkSession, ddl)
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in target.fields}
    rows = [(c, "added") for c in want if c not in have]
    rows += [(c, "rebuilt") for c in want if c in have and have[c] != want[c]]
    rows += [(c, "dropped") for c in have if c not in want]
    return df.sparkSession.createDataFrame(rows, "column string, change string")


def _schema(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def reindex(corpus: DataFrame, path: str) -> None:
    """Rebuild the text index from the corpus as it is now."""
    write_index(corpus, path)


def demo_messages(spark: SparkSession, rows: int, people: int = 50) -> DataFrame:
    """Deterministic chat messages: every value is a function of the row number, so
    the same call gives the same corpus at any size and on any cluster."""
    topics = F.array(*[F.lit(t) for t in ("Machine Learning", "internship", "Flipkart", "trip", "exam", "Kubernetes")])
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    base = spark.range(rows)
    person = pick(1, people)
    return base.select(
        F.concat(F.lit("demo-"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("whatsapp:demo-"), person.cast("string")).alias("conversation_id"),
        F.when(pick(2, 3) == 0, F.lit("Me")).otherwise(F.concat(F.lit("Person "), person.cast("string"))).alias("sender_label"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(pick(3, 90).cast("int"), pick(4, 24).cast("int"))
         ).cast("timestamp_ntz").alias("sent_at"),
        F.concat(F.lit("about the "), F.element_at(topics, (pick(5, 6) + 1).cast("int")), F.lit(" again")).alias("content"),
        F.lit("whatsapp").alias("source"))
