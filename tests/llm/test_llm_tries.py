"""Prefix trie, centroid clustering and exact top-k search against brute force, and hard cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string"
VECTORS = "vec_id bigint, embedding array<float>"


# -- prefix trie -------------------------------------------------------------------------

def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, said, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **names):
    from rapport.llm.op11_prefix_trie import NODE, trie as operator

    got = operator(spark.createDataFrame(rows, TURNS).repartition(4), **names)
    assert got.columns == NODE
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, n=160, most=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-60, 400), n, replace=False).tolist():
        turns = int(rng.integers(1, most))
        rows += [(c, t, ["user", "assistant", None][int(rng.integers(3))] if rng.random() < 0.2 else "user",
                  f"say {rng.integers(2)} it") for t in range(turns)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations(1)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_with_a_blunt_sketch_and_small_blocks(spark, monkeypatch):
    """Nearly every estimate is too high, conversations spread over many chunks, every parent is hot: same nodes."""
    from rapport.llm import op11_prefix_trie as T

    rows = conversations(2, 60, 40) + [(5, t, "user", f"same {t % 3}") for t in range(100, 400)] + [
        (c, t, "user", f"long {t}") for c in (500, 501, 502) for t in range(50)]
    for name, value in (("BITS", 2), ("LEAST_BITS", 4), ("MOST_BITS", 5), ("PACKED", 30), ("HOT", 10)):
        monkeypatch.setattr(T, name, value)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_hard_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "user", "c"), (None, 0, "user", "a"), (None, None, None, None),
            (2, 5, "", ""), (3, -4, "user", "x " * 100_000), (40, 0, "user", "p"), (41, 0, "user", "p"), (42, 0, "user", "p"), (43, 0, "user", "p"),
            (-5, 0, "user", "p"), (-25, 1, "user", "p"), (61, 0, "user", "q"), (62, 0, "user", "q"), (63, 0, "user", "q"), (64, 0, "user", "q")]
    rows += [(c, t, "user", "same") for c in range(200, 280) for t in range(3)]
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "a")]) == []
    from rapport.llm.op11_prefix_trie import trie as operator
    clash = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("conv", "d", "at", "chunk", "many", "depth", "p1", "salt")])
    assert sorted((tuple(r) for r in operator(clash).collect()), key=str) == brute_trie(rows)


# -- clustering ------------------------------------------------------------------------------

@pytest.mark.parametrize("seed,k,width", [(0, 8, 64), (1, 50, 3), (2, 1, 5), (3, 20, 1)])
def test_nearest_centroids(seed, k, width):
    from rapport.llm.op12_centroids import nearest

    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (k, width))
    centroids[k // 2] = centroids[0]                                  # ties
    who, distance = nearest(points, centroids)
    full = np.square(points[:, None] - centroids[None]).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    far = np.full((2, width), 1 << 27)
    far[1] *= -1
    assert nearest(far[:1], far[1:])[1][0] == width * (1 << 56)


def brute_clusters(rows, k, rounds, width):
    from rapport.llm.op12_centroids import LARGEST

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(1024 * x) <= LARGEST for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]
    if not centroids:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    done = [(i, *near(v)) for i, v in kept]
    sums = {n: sum(d for _, d, m in done if m == n) for n in range(len(centroids))}
    return sorted([(i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for i, d, n in done], key=str)


def test_clusters_equal_brute_force(spark):
    from rapport.llm.op12_centroids import clustered

    rng = np.random.default_rng(5)
    vector = lambda: [float(np.float32(x)) for x in rng.standard_normal(6)]
    rows = [(i, vector()) for i in range(60)] + [(7, [0.5] * 6)] * 4 + [
        (None, vector()), (100, None), (101, []), (102, [1.0] * 5), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5),
        (105, [None] + [1.0] * 5), (106, [1e30] * 6), (107, [0.0] * 6), (108, [-0.0] * 6), (109, [2.0 ** 17] * 6)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("point", "cluster", "hash", "v")])
    got = sorted((tuple(r) for r in clustered(docs, k=5, rounds=4, width=6).collect()), key=str)
    assert got == brute_clusters(rows, 5, 4, 6) and len(got) == 68
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert sorted((tuple(r) for r in clustered(few, k=5, rounds=4, width=6).collect()), key=str) == brute_clusters(rows[:3], 5, 4, 6)
    assert clustered(docs.limit(0)).collect() == [] and len(clustered(docs.limit(0)).columns) == 6


# -- top-k search -----------------------------------------------------------------------------

def brute_top(rows, every, k):
    kept = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) and abs(1024 * x) <= 1 << 26 for x in v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in kept if m != n)[:k]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 40])
def test_top_matches_equal_brute_force(spark, monkeypatch, least):
    from rapport.llm import op13_topk as S

    monkeypatch.setattr(S, "SHARD_LEAST", least)
    rng = np.random.default_rng(6)
    vector = lambda n: [float(np.float32(x)) for x in rng.integers(-2, 3, n) / 4 * (rng.random(n) < 0.5)]
    rows = [(i, vector(8)) for i in range(120)] + [(i, vector(3)) for i in range(120, 130)] + [
        (0, vector(8)), (0, [0.25] * 8), (0, [0.25] * 8), (None, vector(8)), (None, [1.0] * 8), (200, None), (201, []), (210, []),
        (202, [float("nan")] * 8), (203, [float("-inf")] * 8), (204, [None] * 8), (205, [1e9] * 8), (220, [60_000.0, -60_000.5] * 4),
        (230, [-60_000.0, 60_000.25] * 4)]
    docs = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("row", "shard", "ask", "v", "point", "rank")])
    got = sorted((tuple(r) for r in S.top_matches(docs, every=10, k=7).collect()), key=str)
    assert got == brute_top(rows, 10, 7)
    assert S.top_matches(docs.limit(0)).collect() == []
    two = spark.createDataFrame([(10, [1.0]), (11, [2.0])], VECTORS)
    assert [tuple(r) for r in S.top_matches(two, every=10, k=7).collect()] == [(10, 1, 11, 2048 * 1024)]


def test_shard_leaves_terms_out(spark):
    """The bounds do split the terms, and what is found stays exact."""
    from rapport.llm.op13_topk import Shard
    import pyarrow as pa

    rng = np.random.default_rng(7)
    points = rng.integers(-200, 200, (3_000, 32)) * (rng.random((3_000, 32)) < 0.2)
    shard = Shard([pa.RecordBatch.from_pydict({"row": np.arange(3_000), "vec_id": np.arange(3_000), "point": points.tolist()})])
    for q in points[:20]:
        at, score = shard.search(q, -1, 10)
        want = points @ q
        assert score.tolist() == sorted(want.tolist(), reverse=True)[:10]
        assert at.tolist() == np.lexsort([np.arange(3_000), -want])[:10].tolist()
