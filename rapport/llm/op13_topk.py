"""Exact top-k search by inner product in whole numbers: MaxScore over shards.

The terms of a query are its components; a term's postings are the shard's vectors with their values of that component. A
term's score bound is the largest product the shard allows. Terms are taken by falling bound. Once the bounds of the last
ones add up to less than the k-th best score known, a vector that gets nothing from the other, essential terms cannot be
among the best. Only essential postings are traversed; the remaining terms are probed for the vectors that could still
reach the k-th best score, fewer with every step. The first such score comes from champions, the vectors with the largest
products in the query's strongest terms.

Vectors are dealt to shards of a bounded size, each shuffled once. Queries go to every shard and stream through the task
that holds it, which keeps no query; a shard gives at most k rows a query, and these are merged, cut to k before the
shuffle. The stated query set against all rows is the contract.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do those with a
component beyond ``LARGEST``; shorter vectors count as filled up with zeros, empty ones score 0. Rows with a null id are
candidates (after all others in ties) but no queries. Repeated rows are candidates and queries of their own; a query's own
row, not its id, is left out. With fewer candidates than k all are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rapport.llm.op12_centroids import usable, whole
from rapport.llm.shared import col, staged, table

TOP, EVERY = 10, 100
LARGEST = 1 << 26
#: Bytes of a shard's postings, and the fewest vectors worth a shard of their own.
SHARD_BYTES, SHARD_LEAST = 32 << 20, 1_024
CHAMPIONS, STRONG, PROBED = 32, 4, 8
OUT = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


class Shard:
    """Postings of one shard: a row of values per term."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.row = np.concatenate([p["row"].to_numpy() for p in parts])
        ids = [p["vec_id"] for p in parts]
        self.missing = np.concatenate([i.is_null().to_numpy(zero_copy_only=False) for i in ids])
        self.id = np.concatenate([i.fill_null(0).to_numpy() for i in ids])
        sizes = np.concatenate([p["point"].value_lengths().to_numpy() for p in parts]).astype(np.int64)
        values = np.concatenate([p["point"].flatten().to_numpy() for p in parts])
        width = int(sizes.max(initial=0))
        most = float(np.abs(values.astype(np.int64)).max(initial=0))
        # Doubles hold every partial sum exactly below 2**53; beyond, whole numbers do.
        self.kind = np.float64 if most * LARGEST * max(width, 1) < 2.0 ** 53 or most ** 2 * max(width, 1) < 2.0 ** 52 else np.int64
        self.most = most
        self.values = np.zeros((width, len(sizes)), self.kind)
        inside = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.values[inside, np.repeat(np.arange(len(sizes)), sizes)] = values
        self.high, self.low = self.values.max(axis=1, initial=0), self.values.min(axis=1, initial=0)
        few = min(CHAMPIONS, len(sizes))
        best = [np.argpartition(v, len(v) - few)[-few:] for v in self.values]
        worst = [np.argpartition(v, few - 1)[:few] for v in self.values]
        self.champions = np.array([best, worst]).reshape(2, width, few)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best, without row ``own``."""
        q = query[:len(self.values)].astype(self.kind)
        if self.kind == np.float64 and float(np.abs(q).max(initial=0)) * self.most * max(len(q), 1) >= 2.0 ** 53:
            q, values = q.astype(np.int64), self.values[:len(q)].astype(np.int64)
        else:
            values = self.values[:len(q)]
        bound = np.maximum(np.maximum(q * self.high[:len(q)], q * self.low[:len(q)]), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)         # rest[i]: bounds of the terms from i on
        known = self._known(values, q, order, own, k)
        essential = len(order) if known is None else int(np.argmax(np.append(rest < known, True)))
        terms = order[:min(essential, len(order))]
        score = q[terms] @ values[terms] if len(terms) else np.zeros(values.shape[1], q.dtype)
        alive = np.flatnonzero(self.row != own)
        score, at = score[alive], len(terms)
        while True:
            if known is not None:
                fit = score + rest[at] >= known
                alive, score = alive[fit], score[fit]
            if at == len(order):
                break
            terms = order[at:at + PROBED]
            score = score + q[terms] @ values[np.ix_(terms, alive)]
            at += len(terms)
        if len(alive) > k:
            fit = score >= np.partition(score, len(score) - k)[-k]
            alive, score = alive[fit], score[fit]
        best = np.lexsort([self.row[alive], self.id[alive], self.missing[alive], -score])[:k]
        return alive[best], score[best].astype(np.int64)

    def _known(self, values, q, order, own: int, k: int):
        """The k-th best score among the champions of the strongest terms."""
        strong = order[:STRONG]
        if not len(strong):
            return None
        at = np.unique(np.concatenate([self.champions[int(q[t] < 0), t] for t in strong]))
        at = at[self.row[at] != own]
        if len(at) < k:
            return None
        score = q @ values[:, at]
        return np.partition(score, len(score) - k)[-k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, shard = None, [], None
        for batch in batches:
            shards, asks = batch["shard"].to_numpy(), batch["ask"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if shards[low] != number:
                    number, parts, shard = shards[low], [], None
                if not asks[low]:
                    parts.append(part)
                    continue
                if shard is None and parts:
                    shard, parts = Shard(parts), []
                if shard is not None:
                    yield _answers(shard, part, k)

    return run


def _answers(shard: Shard, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    sizes = part["point"].value_lengths().to_numpy()
    values, ends = part["point"].flatten().to_numpy(), np.cumsum(sizes)
    rows, ids = part["row"].to_numpy(), part["vec_id"].to_numpy()
    found = [shard.search(values[e - n:e], row, k) for row, n, e in zip(rows, sizes, ends)]
    many = [len(at) for at, _ in found]
    at = np.concatenate([a for a, _ in found])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, many)), pa.array(np.repeat(ids, many)), pa.array(shard.row[at]),
                                       pa.array(shard.id[at], mask=shard.missing[at]), pa.array(np.concatenate([s for _, s in found]))],
                                      ["query", "query_id", "row", "vec_id", "score"])


def top_matches(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by ``every``."""
    own = rows.select(col(key).cast("bigint").alias("vec_id"), col(vector).alias("v"), F.monotonically_increasing_id().alias("row"))
    points = staged(own.where(usable(F.col("v"), LARGEST)).select("row", "vec_id", whole(F.col("v")).alias("point")), "points")
    size = points.agg(F.count("*").alias("n"), F.max(F.size("point")).alias("width")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    full = max(1, SHARD_BYTES // (8 * max(size.width or 1, 1)))
    shards = max(-(-size.n // full), min(cores, size.n // SHARD_LEAST), 1)
    held = points.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("ask"), "*")
    asked = points.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
                                                              F.lit(True).alias("ask"), "*")
    dealt = held.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "ask")
    found = dealt.mapInArrow(_search(k), OUT)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    return top_matches(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS p FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.p, c.p) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""
