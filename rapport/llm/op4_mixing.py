"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of all words; what exceeds ``max_copies`` times a source is shared again by weight. A source's
target over its size says how often each of its documents is taken: the whole part is certain, the rest is an inclusion
probability pi. Documents are ranked by their random odds u / (1 - u) over their inclusion odds pi / (1 - pi) (times a
given relative odds column, if any), and taken in that order up to the words still missing; at most ``FILLS`` further
documents, each the nearest in size, close the gap that is left. u comes from the MD5 of id and text, so runs agree.

The cut of a source is found without sorting it: ranks fall into ``BINS`` bins, whose sums are small, and only the bin
that holds the cut is ordered. Decisions are a row per source; they travel to the documents, not the other way.

Defined results: null text has size 0; null sources are one source, last in order; documents of size 0 take part and add
nothing; other texts under one id (null ids are one id) are documents of their own; rows that repeat id and text are one
document of their joint size, taken alike and charged as a whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rapport.llm.shared import col, fresh, staged, table

BINS, FILLS = 4096, 3
#: Sources whose decisions are broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_key(key, text):
    """What tells documents apart: the id and the MD5 of the text."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def uniform(key):
    """A number in (0, 1) from the MD5 of a key."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """source, source_size, target of each source. ``sizes``: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    per = per.withColumn("w", share.cast("bigint")).withColumn("cap", F.col("source_size") * max_copies)
    # Sources in the order in which they reach their cap; the first that stays under it fixes what a unit of weight gets.
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    here = fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    per = (per.withColumn("left", F.sum("source_size").over(every) - F.sum("cap").over(here) + F.col("cap"))
           .withColumn("open", F.sum("w").over(every) - F.sum("w").over(here) + F.col("w"))
           .withColumn("free", F.col("left") * F.col("w") <= F.col("cap") * F.col("open"))
           .withColumn("first", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "source", "left", "open")))
                       .over(every)))
    return per.select("source", "source_size", F.when(F.col("free"), (F.col("w") * F.col("first.left")).cast("double")
                                                      / F.col("first.open")).otherwise(F.col("cap").cast("double"))
                      .alias("target"))


def _rank(df: DataFrame) -> DataFrame:
    pi = F.col("pi")
    return df.withColumn("q", F.when((pi > 0) & (pi < 1), (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi) * F.col("odds"))))


def decisions(sizes: DataFrame, weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """A row per source: its size, target, whole copies, and the cut in Pareto order.

    ``sizes``: key (string), source, size, u, odds. Staged, as it is read by every document.
    """
    # Equal documents are one from here on; odds differ between them only where the caller's column does.
    sizes = staged(sizes.groupBy("key", "source").agg(F.sum("size").alias("size"), F.max("u").alias("u"), F.max("odds").alias("odds")),
                   "mix-classes")
    per = (targets(sizes, weights, max_copies)
           .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")),
                                                                         F.lit(max_copies))).otherwise(0).cast("int"))
           .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
           .withColumn("pi", F.when(F.col("source_size") > 0, F.col("missing") / F.col("source_size")).otherwise(0.0)))
    per = staged(per, "mix-targets")
    ranked = _rank(with_decisions(sizes, per)).where(F.col("q").isNotNull())
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bin")) - F.col("words")
    bins = bins.withColumn("before", before).where(F.col("before") <= F.col("missing"))
    # The last bin that begins within the words still missing holds the cut.
    edge = bins.groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("e")).select(
        F.col("source").alias("s"), F.col("e.bin").alias("b"), F.col("e.before").alias("before"))
    edge = staged(edge, "mix-edges")
    few = edge.count() <= BROADCAST_SOURCES
    within = ranked.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("s")))
    inside = within.where(F.col("bin") == F.col("b"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("q", "key"))       # equal keys count together
    cut = (inside.withColumn("upto", F.col("before") + upto).where(F.col("upto") <= F.col("missing"))
           .groupBy("source").agg(F.max(F.struct("q", "key", "upto")).alias("cut")))
    cut = edge.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "s", F.coalesce("cut.q", F.lit(None).cast("double")).alias("cut_q"), F.col("cut.key").alias("cut_key"),
        F.col("b").alias("cut_bin"), F.coalesce("cut.upto", F.col("before").cast("bigint")).alias("so_far"))
    per = per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    per = staged(per.withColumn("fills", F.array().cast("array<string>")), "mix-cuts")
    for _ in range(FILLS):
        rest = _rank(with_decisions(sizes, per)).where(F.col("q").isNotNull() & ~_taken())
        gap = F.col("missing") - F.col("so_far")
        rest = rest.withColumn("off", F.abs(gap - F.col("size"))).where(F.col("off") < gap)
        fill = rest.groupBy("source").agg(F.min(F.struct("off", "q", "key", "size")).alias("f")).select(F.col("source").alias("s"), "f")
        per = per.join(fill, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumns({
            "fills": F.when(F.col("f").isNull(), F.col("fills")).otherwise(F.array_append("fills", F.col("f.key"))),
            "so_far": F.col("so_far") + F.coalesce("f.size", F.lit(0))}).drop("f")
        per = staged(per, "mix-decisions")
    return per


def with_decisions(df: DataFrame, per: DataFrame) -> DataFrame:
    """Documents (with ``source``) beside their source's decisions; a source without any has none of its rows lost."""
    per = per.withColumnRenamed("source", "s")
    few = per.count() <= BROADCAST_SOURCES
    return df.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _taken():
    """Before or at the cut. A source without a cut in its bin takes all bins before it."""
    q, bin_ = F.col("q"), F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")
    at = F.when(F.col("cut_q").isNull(), F.lit(False)).otherwise(
        (q < F.col("cut_q")) | ((q == F.col("cut_q")) & (F.col("key") <= F.col("cut_key"))))
    return F.coalesce((bin_ < F.col("cut_bin")) | at, F.lit(False)) | F.array_contains("fills", F.col("key"))


def prepared(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", odds: str | None = None):
    """key, source, size, u and odds of every row."""
    name = row_key(col(key), col(text))
    return docs.select(name.alias("key"), col(source).alias("source"), n_words(col(text)).alias("size"), uniform(name).alias("u"),
                       (col(odds).cast("double") if odds else F.lit(1.0)).alias("odds"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", odds: str | None = None,
          weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """``docs`` with struct ``mix`` (size, source_size, target, copies, taken); copies may be 0."""
    sizes = staged(prepared(docs, key, source, text, odds), "mix-sizes")
    per = decisions(sizes, weights, max_copies)
    name = fresh(docs, "mix")
    return _applied(docs, per, name, n_words(col(text)), row_key(col(key), col(text)), source, odds)


def _applied(docs: DataFrame, per: DataFrame, name: str, size, key, source: str, odds: str | None) -> DataFrame:
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    flat = docs.select(row, key.alias("key"), col(source).alias("source"), uniform(key).alias("u"), (col(odds).cast("double") if odds else F.lit(1.0)).alias("odds"),
                       size.alias("size"))
    done = _rank(with_decisions(flat, per))
    copies = F.col("whole") + _taken().cast("int")
    return done.select("row", F.struct("size", "source_size", "target", copies.alias("copies"),
                                       (F.col("size") * copies).alias("taken")).alias("mix")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns], F.col("mix").alias(name))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with its own columns."""
    done = mixed(docs)
    name = done.columns[-1]
    turn = fresh(done, "turn")
    return (done.where(F.col(name)["copies"] > 0)
            .withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])))
            .select(*[col(c) for c in docs.columns]))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                               row_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    ready = sizes.select("key", "source", "size", uniform(F.col("key")).alias("u"), F.lit(1.0).alias("odds"))
    done = _applied(sizes, decisions(ready), "mix", F.col("size"), F.col("key"), "source", None)
    return done.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL = r"""
WITH k AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, '')) AS key FROM documents),
d AS (SELECT *, (('0x' || substr(md5(key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
a AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
b AS (SELECT *, sum(source_size) OVER () - sum(cap) OVER f + cap AS remaining, sum(w) OVER () - sum(w) OVER f + w AS open
  FROM a WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
z AS (SELECT remaining AS r0, open AS o0 FROM b WHERE remaining * w <= cap * open ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN remaining * w <= cap * open
  THEN CAST(CAST(w * (SELECT r0 FROM z) AS BIGINT) AS DOUBLE) / CAST((SELECT o0 FROM z) AS DOUBLE)
  ELSE CAST(cap AS DOUBLE) END AS target FROM b),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS INT) ELSE 0 END AS whole FROM t),
e AS (SELECT *, target - whole * source_size AS missing FROM p),
j AS (SELECT d.*, e.* EXCLUDE (source), CASE WHEN source_size > 0 THEN missing / source_size ELSE 0 END AS pi
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, CASE WHEN pi > 0 AND pi < 1 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM j),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY q, key) END AS upto FROM q),
g0 AS (SELECT *, coalesce(upto <= missing, false) AS taken0,
  missing - coalesce(max(CASE WHEN upto <= missing THEN upto END) OVER (PARTITION BY source), 0) AS gap0 FROM c),
""" + ",\n".join(f"""f{k} AS (SELECT source AS fs, arg_min({{'k': key, 's': size}}, {{'o': abs(gap{k} - size), 'q': q, 'k': key}}) AS fill
  FROM (SELECT source, key, q, gap{k}, sum(size) AS size FROM g{k} WHERE q IS NOT NULL AND NOT taken{k} GROUP BY source, key, q, gap{k})
  WHERE abs(gap{k} - size) < gap{k} GROUP BY source),
g{k + 1} AS (SELECT g{k}.*, taken{k} OR coalesce(key = fill.k, false) AS taken{k + 1}, gap{k} - coalesce(fill.s, 0) AS gap{k + 1}
  FROM g{k} LEFT JOIN f{k} ON g{k}.source IS NOT DISTINCT FROM f{k}.fs)""" for k in range(FILLS)) + f"""
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN taken{FILLS} THEN 1 ELSE 0 END) AS taken FROM g{FILLS}"""
