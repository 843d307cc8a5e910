"""Centroid clustering in whole numbers: nearest centroids by the threshold algorithm.

For every dimension the centroids stand in a list sorted by that component. From a vector's own component the list is
walked outward, the nearer side first. A centroid met for the first time gets its exact distance. The next entries of all
lists, the frontier, bound every centroid not met yet: none is nearer than the sum of the squared frontier gaps. The walk
of a vector ends when that sum strictly exceeds its best exact distance, so that equal distances still meet and the
smaller number wins, or when all centroids were met.

A round reads the vectors in place: each task adds up its vectors by centroid, so a row per centroid and task is
shuffled, and the driver gets one number per centroid and dimension. New components are exact floors of whole quotients.

Defined results: vectors that are null, have another length, or hold a null or non-finite component take no part, nor do
those with a component beyond ``LARGEST`` (its squared distances would not fit 64 bits). A null id is clustered but does
not start a centroid. Repeated rows are vectors of their own and may start several centroids; equal hashes go by
components. With fewer vectors than centroids there are as many centroids as vectors; without vectors with an id there
are none, and no rows. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm.shared import col, staged, table

CENTROIDS, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
#: Components are whole multiples of 1 / SCALE; their size is at most LARGEST, which keeps squared distances below 2**62.
SCALE, LARGEST = 1_024, 1 << 27
SLICE = 4_096


def whole(vector):
    """Each component times ``SCALE``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def usable(vector, largest: int = LARGEST):
    """Whether all components are numbers that fit (false for null)."""
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) <= largest / SCALE, F.lit(False))
    return F.coalesce(F.forall(vector, lambda x: fits(x) & ~F.isnan(x.cast("double"))), F.lit(False))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest centroid; ties go to the smaller number."""
    k, width = centroids.shape
    far = np.int64(2 * LARGEST)
    order = centroids.argsort(axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, 0)
    right = np.stack([np.searchsorted(lists[:, j], points[:, j]) for j in range(width)], axis=1)
    left = right - 1
    best = np.full(len(points), np.iinfo(np.int64).max)
    who = np.zeros(len(points), np.int64)
    met = np.zeros((len(points), k), bool)
    live, dims = np.arange(len(points)), np.arange(width)
    while len(live):
        here = points[live]
        low = np.where(left >= 0, here - lists[np.maximum(left, 0), dims], far)
        high = np.where(right < k, lists[np.minimum(right, k - 1), dims] - here, far)
        on = (np.square(np.minimum(low, high)).sum(axis=1) <= best[live]) & ~met[live].all(axis=1)
        live, left, right, here, low, high = (x[on] for x in (live, left, right, here, low, high))
        down = low <= high
        read = order[np.where(down, left, right), dims]
        for c in range(k):
            new = np.flatnonzero((read == c).any(axis=1) & ~met[live, c])
            if len(new):
                at, distance = live[new], np.square(here[new] - centroids[c]).sum(axis=1)
                nearer = (distance < best[at]) | ((distance == best[at]) & (c < who[at]))
                best[at[nearer]], who[at[nearer]] = distance[nearer], c
                met[at, c] = True
        left, right = left - down, right + ~down
    return who, best


def _slices(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            points = part["point"].flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
            yield part, points, *nearest(points, centroids)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, points, who, _ in _slices(batches, centroids):
            count += np.bincount(who, minlength=len(centroids))
            np.add.at(total, who, points)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(count),
                                          pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, who, distance in _slices(batches, centroids):
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(who.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return run


def starts(points: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    ranked = points.where("vec_id IS NOT NULL").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "point")
    first = ranked.orderBy("hash", "point").limit(k).collect()          # k rows
    return np.array([r.point for r in first], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    sums = points.mapInArrow(_sums(centroids), "cluster int, n bigint, total array<bigint>").where("n > 0")
    totals = sums.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for row in totals.collect():                                        # a row per centroid and dimension
        out[row.cluster, row["at"]] = row.x // row.n
    return out


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
              width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    own = rows.select(col(key).cast("bigint").alias("vec_id"), col(vector).alias("v"))
    points = staged(own.where((F.size("v") == width) & usable(F.col("v"))).select("vec_id", whole(F.col("v")).alias("point")), "points")
    spark = rows.sparkSession
    centroids = starts(points, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
                                         "centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(points, centroids)
    done = staged(points.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: n if n < 1 << 63 else None
    whole_sum = sum(int(r.s) for r in sums)
    facts = spark.createDataFrame([(r.cluster, fits(int(r.s)), fits(whole_sum), digest[r.cluster]) for r in sums],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(             # a row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = """a{r} AS MATERIALIZED (SELECT id, arg_min(k, [CAST(d AS BIGINT), k]) AS k, min(d) AS d FROM (
  SELECT p.id, c.k, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{r} c ON c.j = p.j GROUP BY p.id, c.k) GROUP BY id)"""
    move = """c{s} AS MATERIALIZED (SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT a.k, p.j, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN p ON p.id = a.id GROUP BY a.k, p.j) m
  ON m.k = c.k AND m.j = c.j)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r), move.format(r=r, s=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {WIDTH}),
p AS MATERIALIZED (SELECT id, vec_id, unnest(range(1, {WIDTH} + 1)) AS j,
  CAST(floor({SCALE} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM v),
f AS (SELECT id, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM v
  WHERE vec_id IS NOT NULL QUALIFY k < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT f.k, p.j, p.x FROM f JOIN p ON p.id = f.id),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS s FROM c{ROUNDS} GROUP BY k)
SELECT v.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  h.s AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.id = a.id JOIN h ON h.k = a.k"""


SQL = _sql()
