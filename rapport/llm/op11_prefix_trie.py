"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

A conversation is first rebuilt: its first turns come from the conversation that opens its group of ids, then follow its
own. Every prefix has a digest, the exclusive-or of hashes of (position, turn), so it can be added up in blocks and no task
needs a whole conversation. All digests are counted in a sketch of fixed size that all tasks fill and that is broadcast. A
sketch never counts too little: an estimate of one proves that no other conversation has this prefix, so the node is given
out where its row lies, with nothing to group. Only prefixes that may be shared are shuffled, and grouping them is exact,
whatever the sketch took for shared.

Sums over subtrees need no walk from level to level. A node's saving, and a leaf, is booked at the smallest conversation
that has it; along a conversation these are added up from its end, and a node's subtree holds what its members booked at
its depth or deeper. Ids of conversations that end in a node are packed in sorted runs before they meet at the hash.

Defined results: turns go by number (null first), equal numbers by the SHA-256 of role and text; null role or text is
empty; repeated rows are turns of their own; rows without conversation id take no part; ids below zero belong to the group
that ``%`` gives (towards zero); an empty table has no nodes. Prefixes are told apart by 128 bits and their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rapport.llm.bitmaps import SCHEMA, gathered, pieces
from rapport.llm.shared import col, staged, table

#: Ids from a multiple of GROUP on share their first turns, fewer than HEAD.
GROUP, HEAD = 20, 4
#: Rows of a conversation that are added up together.
BITS = 10
#: Cells of a sketch row: CELLS for each prefix, between these powers of two. Beyond, estimates are less sharp and more
#: prefixes are shuffled; results stay as they are.
CELLS, LEAST_BITS, MOST_BITS, SKETCH_ROWS = 4, 12, 24, 2
#: Characters of packed ids that stay together.
PACKED = 1 << 16
#: A node with more than one HOT-th of all shared rows is a hot parent. A row belongs to one node, so these are at most HOT.
HOT = 4_096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["p1", "p2", "depth"]


def _mark(seed: int, position, digest):
    return F.xxhash64(F.lit(seed), position, digest)


def through(seed: int, most):
    """Digest of the first ``most`` turns of ``head``."""
    return F.aggregate(F.filter("head", lambda x: x.p <= most), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(_mark(seed, x.p, x.d)))


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, d (128 bits of the turn's SHA-256), words, at: ``at`` grows in the order of turns, through all rows."""
    said = F.coalesce(col(role).cast("string"), F.lit(""))
    told = F.coalesce(col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, told), 256)
    rows = turns.where(col(conv).isNotNull()).select(
        col(conv).cast("bigint").alias("conv"), col(turn).cast("bigint").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("d"),
        F.regexp_count(told, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("salt"))
    by = ["conv", "turn", "d", "salt"]           # the salt only parts rows that are equal, so that no range is one task's
    rows = staged(rows, "chat-digests").repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(rows.select("conv", "d", "words", F.monotonically_increasing_id().alias("at")), "chat-ordered")


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All prefixes of the rebuilt conversations (conv, depth, words, last, p1, p2 and those of the prefix before, q1, q2),
    and the conversations (conv, total)."""
    rows = ordered(turns, conv, turn, role, text).withColumn("chunk", F.shiftright("at", BITS))
    runs = rows.groupBy("conv", "chunk").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")), "chat-runs")
    place = F.col("at") - F.col("first") + F.col("ahead") + 1

    opening = (rows.where(F.col("conv") % GROUP == 0).join(runs.where(F.col("ahead") < HEAD - 1), ["conv", "chunk"])
               .select("conv", place.alias("p"), "d", "words").where(F.col("p") < HEAD))
    heads = opening.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "d", "words"))).alias("head"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    info = (runs.groupBy("conv").agg(F.sum("n").alias("len")).withColumn("h", taken)
            .withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(heads, "base", "left"))
    info = info.withColumn("head", F.when(F.col("h") > 0, F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array()))
                           .otherwise(F.array()).cast("array<struct<p:bigint,d:binary,words:bigint>>"))
    added = F.size("head").cast("bigint")
    info = staged(info.select("conv", "h", "head", added.alias("b"), (added + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total"),
                              *[through(s, F.lit(HEAD)).alias(f"x{s}") for s in (1, 2)]), "chat-heads")

    own = rows.join(runs.join(info.drop("head"), "conv"), ["conv", "chunk"]).withColumn("p", place).where(F.col("p") > F.col("h"))
    own = own.withColumn("depth", F.col("p") - F.col("h") + F.col("b"))
    own = own.withColumns({f"f{s}": _mark(s, F.col("depth"), F.col("d")) for s in (1, 2)})
    inside = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("conv", "chunk", "depth", "words", (F.col("depth") == F.col("total")).alias("last"), "f1", "f2",
                     *[F.bit_xor(f"f{s}").over(inside).bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in (1, 2)], (F.col("ahead") > 0).alias("later"))
    own = staged(own, "chat-own")
    # What a conversation's earlier chunks hold, for its later ones.
    several = own.where("later").select("conv").distinct()
    sums = own.join(several, "conv", "left_semi").groupBy("conv", "chunk").agg(*[F.bit_xor(f"f{s}").alias(f"f{s}") for s in (1, 2)])
    carry = sums.select("conv", "chunk", *[F.bit_xor(f"f{s}").over(earlier).alias(f"c{s}") for s in (1, 2)])
    moved = own.where("later").join(carry, ["conv", "chunk"], "left")
    moved = moved.withColumns({f"p{s}": F.col(f"p{s}").bitwiseXOR(F.coalesce(f"c{s}", F.lit(0))) for s in (1, 2)}).select(own.columns)
    own = own.where("NOT later").union(moved).select(
        "conv", "depth", "words", "last", "p1", "p2", *[F.col(f"p{s}").bitwiseXOR(F.col(f"f{s}")).alias(f"q{s}") for s in (1, 2)])

    lent = info.select("conv", "total", "head", F.explode("head").alias("turn"))
    lent = lent.select("conv", F.col("turn.p").alias("depth"), F.col("turn.words").alias("words"), (F.col("turn.p") == F.col("total")).alias("last"),
                       *[through(s, F.col("turn.p")).alias(f"p{s}") for s in (1, 2)],
                       *[through(s, F.col("turn.p") - 1).alias(f"q{s}") for s in (1, 2)])
    return staged(own.union(lent), "chat-prefixes"), info.select("conv", "total")


def cells(p1: np.ndarray, p2: np.ndarray, width: int) -> list[np.ndarray]:
    """The sketch cell of each digest, in each row of the sketch."""
    mask = np.int64(width - 1)
    return [(p & mask) + i * width for i, p in enumerate((p1, p2))]


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_ROWS * width, np.uint8)
        for batch in batches:
            for row in cells(batch["p1"].to_numpy(), batch["p2"].to_numpy(), width):
                at, n = np.unique(row, return_counts=True)
                sketch[at] = np.minimum(sketch[at] + np.minimum(n, 2), 2)
        yield pieces(sketch)

    return run


def _at_most_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a + b, 2).astype(np.uint8)


def screened(prefixes: DataFrame) -> DataFrame:
    """Prefixes with ``many`` (may be shared) and ``above`` (so may be the prefix before; false at the root)."""
    n = prefixes.count()
    width = 1 << min(max((CELLS * n).bit_length(), LEAST_BITS), MOST_BITS)
    sketch = gathered(prefixes.select("p1", "p2").mapInArrow(_count(width), SCHEMA), _at_most_two, np.uint8, SKETCH_ROWS * width)
    sent = prefixes.sparkSession.sparkContext.broadcast(np.packbits(sketch >= 2))

    @F.arrow_udf("boolean")
    def shared(p1: pa.Array, p2: pa.Array) -> pa.Array:
        bits, out = sent.value, np.ones(len(p1), bool)
        for at in cells(p1.to_numpy(), p2.to_numpy(), width):
            out &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pa.array(out)

    out = staged(prefixes.withColumns({"many": shared("p1", "p2"), "above": shared("q1", "q2")})
                 .withColumn("above", F.col("above") & (F.col("depth") > 1)), "chat-screened")
    sent.destroy()
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, which come in order, as texts."""
    key, ids, size, out = None, [], 0, []

    def close():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])],
                                          [*KEY, "first", "ids"])

    for batch in batches:
        for *node, conv in zip(*(batch[c].to_pylist() for c in [*KEY, "conv"])):
            if node != key or size > PACKED:
                close()
                key, ids, size = node, [], 0
            ids.append(conv)
            size += 20
        if out:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's packed ids, which come in order; only the hash's state is kept."""
    key, state = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch[c].to_pylist() for c in [*KEY, "ids"])):
            if node == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = node, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*KEY, "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], [*KEY, "ends"])


def end_hashes(rows: DataFrame) -> DataFrame:
    """p1, p2, depth, ends: hash of the ids (``conv``) of each node, ascending and joined by commas."""
    by = [*KEY, "conv"]
    packed = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _pack, "p1 bigint, p2 bigint, depth bigint, first bigint, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hash, "p1 bigint, p2 bigint, depth bigint, ends string")


def booked(members: DataFrame, entries: DataFrame) -> DataFrame:
    """saved and leaves of each node: what its members' ``entries`` (conv, depth, v, leaf) hold from its depth on."""
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("p1", "p2")]
    rows = members.select("conv", "depth", "p1", "p2", F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("leaf")).union(
        entries.select("conv", "depth", *nothing, "v", "leaf")).withColumn("block", F.shiftright("depth", BITS))
    below = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    # What a conversation's deeper blocks hold; few conversations have any.
    long = rows.where("block > 0").select("conv").distinct()
    sums = rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.sum("v").alias("v"), F.max("leaf").alias("leaf"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv", "block", F.sum("v").over(deeper).alias("cv"), F.max("leaf").over(deeper).alias("cl"))
    rows = rows.select("*", F.sum("v").over(below).alias("sv"), F.max("leaf").over(below).alias("sl")).where("p1 IS NOT NULL")
    rows = rows.join(carry, ["conv", "block"], "left")
    return rows.groupBy(*KEY).agg(F.sum(F.col("sv") + F.coalesce("cv", F.lit(0))).alias("saved"),
                                  F.sum(F.greatest("sl", F.coalesce("cl", F.lit(0)))).alias("leaves"))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node (``NODE``)."""
    prefixes, convs = rebuilt(turns, conv, turn, role, text)
    rows = screened(prefixes)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    nobody = F.sha2(F.lit(""), 256)
    alone, members = rows.where("NOT many"), rows.where("many")
    edge = alone.where("above")                                           # first prefixes that are nobody else's

    nodes = staged(members.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("words").alias("words"),
        *[F.any_value(c).alias(c) for c in ("q1", "q2", "above")]), "chat-nodes")
    up = [F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("above").select(*up).union(edge.select(*up)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "chat-nodes")

    entries = nodes.where("n_convs > 1 OR n_children = 0").select(
        F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("v"), (F.col("n_children") == 0).cast("int").alias("leaf"))
    # Every conversation that leaves the shared part books its leaf where it does.
    entries = entries.union(edge.select("conv", F.col("depth") - 1, zero, F.lit(1)))
    totals = booked(members, entries)
    no_turns = convs.where("total = 0").select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv")
    ends = staged(end_hashes(members.where("last").select(*KEY, "conv").union(no_turns)), "chat-ends")

    root = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    if not root.n:
        return turns.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in NODE))
    shared = nodes.agg(F.sum("n_convs").alias("rows"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                       F.count_if(F.col("n_children") == 0).alias("leaves"), F.count_if(F.col("depth") == 1).alias("tops")).first()
    single = alone.agg(F.count_if("last").alias("leaves"), F.count_if(F.col("depth") == 1).alias("tops")).first()
    ended = [r.ends for r in ends.where("depth = 0").collect()]           # one row at most
    top = F.lit(root.least).cast("bigint")

    # Parents' numbers: nodes with very many rows are few and are broadcast, so their children stay where they are.
    parents = nodes.select(*[F.col(k).alias(f"parent_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"), "n_convs")
    big = F.broadcast(parents.where(F.col("n_convs") > max(shared.rows or 0, 1) // HOT).drop("n_convs"))

    def with_parent(children: DataFrame) -> DataFrame:
        children = children.withColumns({"parent_p1": F.col("q1"), "parent_p2": F.col("q2"), "parent_depth": F.col("depth") - 1})
        on = [f"parent_{k}" for k in KEY]
        return children.join(big, on).unionByName(children.join(big, on, "left_anti").join(parents.drop("n_convs"), on))

    def above(df: DataFrame, own: str) -> DataFrame:
        """``df`` with parent_conv_id: the root's, that of a shared node, or (a prefix of nobody else) the same conversation."""
        rest = df.where("NOT above").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top).otherwise(F.col(own)))
        return with_parent(df.where("above")).select(*df.columns, "parent_conv_id").union(rest)

    lonely = above(alone, "conv").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", one.alias("n_convs"), (~F.col("last")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"))
    common = above(nodes.join(totals, KEY).join(ends, KEY, "left"), "conv_id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").cast("bigint").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", nobody).alias("ends_sha256"))
    tops = shared.tops + single.tops
    start = turns.sparkSession.range(1).select(
        top.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(root.n).cast("bigint").alias("n_convs"),
        F.lit(tops).cast("bigint").alias("n_children"), F.lit(shared.leaves + single.leaves if tops else 1).cast("bigint").alias("n_leaves"),
        F.lit(shared.saved or 0).cast("bigint").alias("saved_tokens"), (F.lit(ended[0]) if ended else nobody).alias("ends_sha256"))
    return lonely.union(common).union(start)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(c AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))), lambda a, b: list_reduce(
    list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS r
  FROM ids),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(r, 4294967295) % 4 AS h, c - c % 20 AS base FROM crc),
b AS (SELECT h.c, count(o.p) AS b FROM h LEFT JOIN o ON o.c = h.base AND o.p <= h.h GROUP BY h.c),
t AS (SELECT h.c, o.p AS d, o.role, o.text FROM h JOIN o ON o.c = h.base AND o.p <= h.h
  UNION ALL SELECT h.c, o.p - h.h + b.b, o.role, o.text FROM h JOIN b ON b.c = h.c JOIN o ON o.c = h.c AND o.p > h.h),
k AS (SELECT c, d, text, sha256(string_agg(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), ',')
    OVER (PARTITION BY c ORDER BY d)) AS k, max(d) OVER (PARTITION BY c) = d AS last FROM t
  UNION ALL SELECT ids.c, 0, '', '', NOT EXISTS (SELECT 1 FROM t WHERE t.c = ids.c) FROM ids),
u AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM k),
n AS (SELECT k, min(c) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n,
    (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM u GROUP BY k),
f AS (SELECT n.*, coalesce(x.n_children, 0) AS kids FROM n LEFT JOIN (SELECT up, count(*) AS n_children FROM n GROUP BY up) x ON x.up = n.k),
s AS (SELECT u.k, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(f.saved) AS saved
  FROM u JOIN u y ON y.c = u.c AND y.d >= u.d JOIN f ON f.k = y.k AND f.conv_id = y.c GROUP BY u.k)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON s.k = f.k LEFT JOIN n p ON p.k = f.up"""
