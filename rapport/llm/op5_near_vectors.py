"""Near copies among embeddings: cosine joins with randomised-rotation binary codes.

A vector is rotated at random; its code holds the signs, and a stored factor, the inner product of the vector and its
code, corrects the estimate of an inner product with another vector so that it is unbiased. A bound on the estimate's
error (``SURE`` standard errors) decides: a pair whose upper bound is below the threshold is dropped, every other pair is
computed anew in double precision.

Which pairs are looked at: vectors are dealt to cells by the largest coordinate (and its sign) of further random
rotations. The number of coordinates follows the number of vectors, so that cells stay small, and the number of tables
follows from the chance that a pair at the threshold shares a cell, to find ``RECALL`` of such pairs (pairs above it more
often). Cells of more than ``BLOCK`` vectors are cut in blocks that meet pair by pair. A pair that shares cells in several
tables counts in the first. Tasks give counts and a spanning forest of the links, never all pairs. Equal vectors are
one class from the start, so copies are never compared.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
different lengths do not link; a null id links with nothing, has a null component and is kept; repeated rows are copies;
a cosine of exactly the threshold links. Classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm.components import components
from rapport.llm.shared import col, staged, table

RECALL, SURE = 0.985, 4.0
#: Vectors that a cell should hold, and that a task compares with each other.
CELL, BLOCK = 500, 1_024
MOST_TABLES = 64


@lru_cache(maxsize=256)
def rotation(width: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([width, number]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def padded(width: int) -> int:
    return max(64, -(-width // 64) * 64)


def shares_cell(width: int, cosine: float, trials: int = 4_000) -> float:
    """Chance that two vectors with this cosine have the same largest coordinate after a rotation (by simulation)."""
    rng = np.random.default_rng(width)
    x = rng.standard_normal((trials, width))
    y = rng.standard_normal((trials, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return float((_peak(x) == _peak(cosine * x + math.sqrt(1 - cosine * cosine) * y)).mean())


def _peak(v: np.ndarray) -> np.ndarray:
    at = np.abs(v).argmax(axis=1)
    return 2 * at + (v[np.arange(len(v)), at] < 0)


def plan(vectors: int, width: int, cosine: float) -> tuple[int, int]:
    """Coordinates per cell, and tables."""
    deep = max(1, math.ceil(math.log(max(vectors / CELL, 1)) / math.log(2 * width)))
    chance = shares_cell(width, cosine) ** deep
    return deep, min(MOST_TABLES, max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1 - chance, 1e-12)))))


def unit(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, padded with zeros. All have one length."""
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)       # no overflow in the norm
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    out = np.zeros((rows, padded(values.shape[1])))
    out[:, :values.shape[1]] = values
    return out


def encoder(deep: int, tables: int):
    @F.arrow_udf("struct<code:binary,factor:double,cells:array<bigint>>")
    def encode(column: pa.Array) -> pa.Array:
        rows = len(column)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        codes, factors, cells = [b""] * rows, np.zeros(rows), np.zeros((rows, tables), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            x = unit(column.take(pa.array(at)))
            width = x.shape[1]
            turned = x @ rotation(width, 0)
            factors[at] = np.abs(turned).sum(axis=1) / math.sqrt(width)
            for i, bits in zip(at, np.packbits(turned >= 0, axis=1)):
                codes[i] = bits.tobytes()
            for t in range(tables):
                cell = np.full(len(at), int(length), np.int64)
                for k in range(deep):
                    cell = cell * (2 * width) + _peak(x @ rotation(width, 1 + t * deep + k))
                cells[at, t] = cell
        return pa.StructArray.from_arrays(
            [pa.array(codes, pa.binary()), pa.array(factors),
             pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * tables), pa.array(cells.ravel()))],
            ["code", "factor", "cells"])

    return encode


def estimates(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) and rotated vectors (columns)."""
    return (signs @ turned.T) / (math.sqrt(turned.shape[1]) * factor[:, None])


def errors(factor: np.ndarray, width: int) -> np.ndarray:
    return np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(width - 1)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out = []
    waiting = near.any(axis=1)
    while waiting.any():
        queue = [int(waiting.argmax())]
        waiting[queue[0]] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(near[i] & waiting)
            waiting[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def _compare(cosine: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        number, _, low, high = (k.as_py() for k in key)
        group = group.combine_chunks()
        x = unit(group["embedding"].chunk(0)) if group.num_rows else np.zeros((0, 64))
        n, width = x.shape
        ids, copies, block = (group[c].to_numpy() for c in ("id", "copies", "block"))
        factor = group["factor"].to_numpy()
        cells = group["cells"].chunk(0).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
        near = np.zeros((n, n), bool)
        if n > 1:
            signs = np.unpackbits(np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(n, -1), axis=1)
            signs = signs.astype(np.float32) * 2 - 1
            turned = (x @ rotation(width, 0)).astype(np.float32)
            upper = estimates(turned, signs, factor.astype(np.float32))
            upper += (SURE * errors(factor, width))[:, None].astype(np.float32)
            maybe = np.triu((upper >= cosine) & (upper.T >= cosine), 1)
            if low != high:
                maybe &= block[:, None] != block[None]
            a, b = np.nonzero(maybe)
            for at in range(0, len(a), 50_000):
                i, j = a[at:at + 50_000], b[at:at + 50_000]
                if number:                   # met in an earlier table already
                    new = ~(cells[i, :number] == cells[j, :number]).any(axis=1)
                    i, j = i[new], j[new]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                near[i[hit], j[hit]] = True
            near |= near.T
        more = near @ copies if n else np.zeros(0, np.int64)
        has = more > 0
        pairs = forest(near)
        a = np.array([ids[i] for i, _ in pairs], np.int64)
        b = np.array([ids[j] for _, j in pairs], np.int64)
        return pa.table({"a": np.concatenate([ids[has], a]), "b": pa.concat_arrays([pa.nulls(int(has.sum()), pa.int64()), pa.array(b)]),
                         "links": pa.concat_arrays([pa.array(more[has].astype(np.int64)), pa.nulls(len(b), pa.int64())])})

    return run


def usable(vector):
    """Whether a vector can have a cosine."""
    value = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(value(v)) & (F.abs(value(v)) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    own = rows.select(col(key).alias("vec_id"), col(vector).alias("embedding"))
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    hashed = own.select("vec_id", "embedding", F.when(good, F.xxhash64("embedding")).alias("id"))
    classes = staged(hashed.where("id IS NOT NULL").groupBy("id").agg(
        F.any_value("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    deep, tables = plan(size.n, padded(size.width), cosine) if size.n else (1, 1)
    coded = classes.select("id", "copies", "embedding", encoder(deep, tables)(F.col("embedding")).alias("c"))
    coded = staged(coded.select("id", "copies", "embedding", "c.code", "c.factor", "c.cells"), "codes")
    dealt = coded.select("*", F.posexplode("cells").alias("number", "cell"))
    many = (coded.select(F.posexplode("cells").alias("number", "cell")).groupBy("number", "cell").agg(F.count("*").alias("n"))
            .where("n > 1").select("number", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = (dealt.join(many, ["number", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    found = met.groupBy("number", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = staged(found.applyInArrow(_compare(cosine), "a bigint, b bigint, links bigint"), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("id", "copies", "least").join(label.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("label", F.coalesce("label", "id"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    done = staged(named.join(groups, "label").join(counts, "id", "left").select(
        "id", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-groups")
    component = F.coalesce("component_id", "vec_id")
    return hashed.select("vec_id", "id").join(done, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id
  AND list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id,
  coalesce(least(m, vec_id), vec_id) = vec_id AS kept
FROM e LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
