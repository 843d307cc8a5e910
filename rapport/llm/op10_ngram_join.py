"""Jaccard join on word n-grams by rare-first prefix filtering, and the groups that its links make.

1. One pass over the texts gives each document's set size, a fingerprint of its set, a 128-bin histogram of the set, and
   the counts of n-grams in a fixed number of buckets (a sketch over all documents, summed on the cluster).
2. Documents with equal sets are one class. A class's n-grams are put in order of rising bucket count, and its prefix
   (n - ceil(t n) + 1 of them) becomes postings. Two sets at or above the threshold share a prefix n-gram.
3. First every posting list links each member to its first one and to a few before it: near copies in thousands meet in
   a small multiple of the pairs that there are members. Pairs pass the length filter and the histogram bound (a suffix filter: the sum
   of the smaller counts limits the overlap) and are then verified once, on whole sets.
   This is repeated with each list's likely centre.
4. Then every pair of a list whose members are not yet in one component is treated alike, after the positional filter
   (what is left of both sets behind the shared n-gram limits the overlap) and the histogram bound. Lists beyond ``BLOCK`` members
   are cut in blocks that meet pair by pair. So no link between different components is lost.

Defined results: a text without words (or null) has an empty set and links with nothing; fewer words than n are one
n-gram; a null id is kept with a null component and links nothing; repeated rows are alike and get the same component;
ties do not occur, since sets either reach the threshold (in whole numbers) or do not. Texts are never cut. Sets are held
as 64-bit hashes, of which 48 bits travel to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm import texts as X
from rapport.llm.bitmaps import SCHEMA, gathered, pieces
from rapport.llm.components import components
from rapport.llm.shared import col, fresh, frugal, staged, table

#: Buckets of the n-gram counts; bins of a set's histogram.
BUCKETS, BINS = 1 << 18, 128
#: Members of a posting list that one task compares with each other, and pairs that it holds at once.
BLOCK, AT_ONCE = 4_096, 2_000_000
#: Bits of the filter that says which sets are needed: 16 for each, within these bounds.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28
_M = np.uint64(0xD6E8FEB86659FD93)


def sets_of(rows: X.Rows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ordered within the text, and the bounds of each text's part."""
    count = len(rows.begin)
    data = X.lowered(rows.data)
    begin, end, row = X.words(rows)
    word = X.hashes(data, begin, end)
    many = X.per_row(row, count)
    head = np.cumsum(many) - many
    size = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    bound = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bound[-1]) - np.repeat(bound[:-1], size) + np.repeat(head, size)
    width = np.repeat(np.minimum(many, n), size)
    gram = width.astype(np.uint64)
    for j in range(n):
        inside = j < width
        gram = np.where(inside, gram * _M + word[np.minimum(at + j, len(word) - 1)], gram) if len(word) else gram
    gram = X.mixed(gram)
    for i in range(count):
        gram[bound[i]:bound[i + 1]].sort()
    owner = np.repeat(np.arange(count), size)
    fresh_ = np.ones(len(gram), bool)
    fresh_[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[fresh_], np.concatenate([[0], np.cumsum(X.per_row(owner[fresh_], count))])


def fingerprints(gram: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mixed(gram ^ _M), dtype=np.uint64)])
    return X.mixed(total[bound[1:]] - total[bound[:-1]] + (bound[1:] - bound[:-1]).astype(np.uint64) * _M).view(np.int64)


def histograms(gram: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Counts of each set in ``BINS`` bins, as bytes; 255 stands for 255 or more."""
    rows = len(bound) - 1
    owner = np.repeat(np.arange(rows), np.diff(bound))
    cell = owner * BINS + (gram >> np.uint64(57)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=rows * BINS), 255).astype(np.uint8).reshape(rows, BINS)


def bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(matrix.shape[1]), len(matrix),
                                                [None, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]).cast(pa.binary())


def _profile(n: int):
    names = ["doc_id", "text_key", "n", "fp", "bins", "piece", "counts"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for rows in X.slices(batch.column(2)):
                gram, bound = sets_of(rows, n)
                counts += np.bincount(bucket(gram), minlength=BUCKETS)
                k = len(rows.begin)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.first, k), keys.slice(rows.first, k), pa.array(np.diff(bound)), pa.array(fingerprints(gram, bound)),
                     _binary(histograms(gram, bound)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            own = pieces(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(own.num_rows, pa.int64())] * 4 + [pa.nulls(own.num_rows, pa.binary()), *own.columns], names)

    return run, "doc_id bigint, text_key bigint, n bigint, fp bigint, bins binary, piece int, counts binary"


def _postings(n: int, num: int, den: int, counts):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.minimum(counts.value, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
        seen: set[int] = set()          # classes of this task: copies add no postings
        for batch in batches:
            for rows in X.slices(batch.column(0)):
                gram, bound = sets_of(rows, n)
                key = order[bucket(gram)] | (gram >> np.uint64(24))
                tokens, owners, places, sizes = [], [], [], []
                for i, fp in enumerate(fingerprints(gram, bound).tolist()):
                    a, b = bound[i], bound[i + 1]
                    if a == b or fp in seen:
                        continue
                    seen.add(fp)
                    size = int(b - a)
                    prefix = size - -(-num * size // den) + 1
                    tokens.append(gram[a:b][np.argsort(key[a:b], kind="stable")[:prefix]])
                    owners.append((fp, prefix))
                    places.append(np.arange(prefix))
                    sizes.append(np.full(prefix, size))
                if tokens:
                    fps, widths = np.array(owners, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(fps, widths)),
                         pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                        ["token", "fp", "n", "pos"])

    return run, "token bigint, fp bigint, n int, pos int"


#: How many of the members before it in a list a member is linked to at first, besides the list's first one.
BACK = 1
#: How often members of other components are linked to their lists' centres before all pairs are tried.
ROUNDS = 2
LISTS = "token bigint, fp bigint, n int, pos int, lead bigint, lead_n int, " + "".join(
    f"back{k} bigint, back{k}_n int, " for k in range(BACK)) + "deep boolean"


@frugal
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, ordered by (token, fp): those of tokens with two classes or more, beside their list's first and the
    ``BACK`` before (the first again where there are not so many); ``deep`` where a list has three or more.

    Streams; a batch's last list is held while it has fewer than three.
    """
    names = LISTS.replace(" bigint", "").replace(" int", "").replace(" boolean", "").split(", ")
    held = None                       # rows of a list of one or two
    going = None                      # a list of three or more: token, first fp and n, its last BACK fps and ns

    def given(own, leads, backs, deep):
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (*own, *leads, *backs, deep)], names)

    for batch in batches:
        own = [batch.column(i).to_numpy() for i in range(4)]
        if not len(own[0]):
            continue
        if held is not None:
            own = [np.concatenate(pair) for pair in zip(held, own)]
        keep = np.concatenate([[True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])])
        if going is not None and own[0][0] == going[0] and own[1][0] == going[3][-1]:
            keep[0] = False
        own = [v[keep] for v in own]
        token, count = own[0], len(own[0])
        if not count:
            continue
        opens = np.concatenate([[True], token[1:] != token[:-1]])
        head = np.maximum.accumulate(np.where(opens, np.arange(count), 0))
        many = np.bincount(head, minlength=count)[head]
        leads = [v[head] for v in own[1:3]]
        carried = going is not None and token[0] == going[0]
        if carried:
            first = head == 0
            many[first] = 3
            for values, value in zip(leads, going[1:3]):
                values[first] = value
        place = np.arange(count)
        backs = []
        for k in range(1, BACK + 1):
            for v, lead, tail in zip(own[1:3], leads, going[3:5] if carried else (None, None)):
                at = place - k
                back = np.where(at >= head, v[np.maximum(at, 0)], lead)
                if carried:
                    for j in range(min(k, count)):                # what stood before in the batch before
                        if head[j] == 0 and len(tail) >= k - j:
                            back[j] = tail[j - k]
                backs.append(back)
        last = head == head[-1]
        if many[-1] > 2:
            tails = [np.concatenate([going[3 + i] if carried and head[-1] == 0 else v[:0], v[last]])[-BACK:]
                     for i, v in enumerate(own[1:3])]
            held, going = None, (token[-1], leads[0][-1], leads[1][-1], *tails)
            out = many > 1
        else:
            held, going = [v[last] for v in own], None
            out = (many > 1) & ~last
        if out.any():
            yield given([v[out] for v in own], [v[out] for v in leads], [v[out] for v in backs], many[out] > 2)
    if held is not None and len(held[0]) == 2:
        first = [np.repeat(v[:1], 2) for v in held[1:3]]
        yield given(held, first, first * BACK, np.zeros(2, bool))


def bounded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Most that sets with these histograms can share."""
    both = np.minimum(left, right).astype(np.int64)
    return np.where(both == 255, 1 << 40, both).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def packed(gram: np.ndarray) -> bytes:
    """A set for the way: 48 bits of each hash."""
    return np.ascontiguousarray(gram.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    out = np.zeros((data.as_buffer().size // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    @F.arrow_udf("boolean")
    def possible(left: pa.Array, right: pa.Array, size: pa.Array) -> pa.Array:
        most = bounded(_matrix(left), _matrix(right))
        return pa.array(most * (num + den) >= num * size.to_numpy())

    left, right = (classes.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("bins").alias(f"bins_{k}")) for k in "ab")
    close = staged(pairs.join(left, "a").join(right, "b")
                   .where(possible("bins_a", "bins_b", F.col("n_a") + F.col("n_b"))).select("a", "b"), "pairs")
    needed = close.select(F.col("a").alias("fp")).union(close.select(F.col("b").alias("fp"))).distinct()
    bits = FEWEST_BITS
    many = needed.count()
    if many == 0:
        return close
    while bits < min(16 * many, MOST_BITS):
        bits *= 2

    @frugal
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(), bits):
                seen[at] = 1
        yield pieces(np.packbits(seen))

    filled = gathered(needed.mapInArrow(mark, SCHEMA), np.bitwise_or, np.uint8, bits // 8)
    wanted = texts.sparkSession.sparkContext.broadcast(filled)

    @frugal
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = wanted.value, set()
        for batch in batches:
            for rows in X.slices(batch.column(0)):
                gram, bound = sets_of(rows, n)
                fps = fingerprints(gram, bound)
                hit = np.ones(len(fps), bool)
                for at in _bits(fps, bits):
                    hit &= (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                take = [i for i in np.flatnonzero(hit) if not (fps[i] in seen or seen.add(fps[i]))]
                if take:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps[take]), pa.array([packed(gram[bound[i]:bound[i + 1]]) for i in take], pa.binary())],
                        ["fp", "grams"])

    found = texts.mapInArrow(sets, "fp bigint, grams binary").join(needed, "fp", "left_semi")
    found = staged(found.groupBy("fp").agg(F.any_value("grams").alias("grams")), "sets")

    @F.arrow_udf("boolean")
    def enough(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        for i, (x, y) in enumerate(zip(left, right)):
            both = np.concatenate([unpacked(x), unpacked(y)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out[i] = den * common >= num * (len(both) - common)
        return pa.array(out)

    sides = close.join(found.select(F.col("fp").alias("b"), F.col("grams").alias("grams_b")), "b")
    sides = sides.join(found.select(F.col("fp").alias("a"), F.col("grams").alias("grams_a")), "a")
    return staged(sides.where(enough("grams_a", "grams_b")).select("a", "b"), "verified")


def _bits(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    h = fp.view(np.uint64)
    return [(X.mixed(h + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(4)]


def _cross_pairs(num: int, den: int):
    """Rows in order of (token, low, high): the pairs of each list (or two of its blocks) from different components."""
    def pairs(i, j, fp, size, pos, label, block, bins, split):
        met = (label[i] != label[j]) & ((block[i] != block[j]) | ~split[i])
        i, j = i[met], j[met]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        left = 1 + np.minimum(size[i] - pos[i], size[j] - pos[j]) - 1
        met = (den * small >= num * large) & (left * (num + den) >= num * (small + large))
        i, j = i[met], j[met]
        most = [bounded(bins[i[k:k + 50_000]], bins[j[k:k + 50_000]]) for k in range(0, len(i), 50_000)]
        met = np.concatenate([np.zeros(0, np.int64), *most]) * (num + den) >= num * (size[i].astype(np.int64) + size[j])
        i, j = i[met], j[met]
        return np.unique(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])], axis=1), axis=0)

    def compared(columns):
        token, low, high, fp, size, pos, label, block, bins = columns
        n = len(token)
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, n))
        owner = np.cumsum(new) - 1
        after = (start + many)[owner] - np.arange(n) - 1           # members behind each in its list
        upto = np.concatenate([[0], np.cumsum(after)])
        split = low != high
        at = 0
        while at < n:                                              # some rows at once, each with all behind it
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_ONCE, "right")) - 1)
            i = np.repeat(np.arange(at, stop), after[at:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:stop] - upto[at], after[at:stop])
            found = pairs(i, j, fp, size, pos, label, block, bins, split)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            at = stop

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None                                             # a list goes on in the next batch
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:-1]] + [_matrix(batch.columns[-1])]
            if not len(columns[0]):
                continue
            if waiting is not None:
                columns = [np.concatenate(pair) for pair in zip(waiting, columns)]
            token, low, high = columns[:3]
            last = (token == token[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(last.argmax())
            if cut:
                yield from compared([c[:cut] for c in columns])
            waiting = [c[cut:] for c in columns]
        if waiting is not None:
            yield from compared(waiting)

    return run


def links(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, text_key, n, fp) of all documents, and (fp, label) of the classes that link with another class."""
    spark = docs.sparkSession
    run, schema = _profile(n)
    own = docs.select(col(key).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("text_key"), col(text).alias("text"))
    profile = staged(own.mapInArrow(run, schema), "profiles")
    counts = spark.sparkContext.broadcast(
        gathered(profile.where("piece IS NOT NULL").select("piece", "counts"), np.add, np.int64, BUCKETS))
    profile = profile.where("piece IS NULL").select("doc_id", "text_key", "n", "fp", "bins")
    classes = staged(profile.where("doc_id IS NOT NULL AND n > 0").groupBy("fp").agg(
        F.any_value("n").alias("n"), F.any_value("bins").alias("bins")), "classes")
    texts = docs.where(col(key).isNotNull() & col(text).isNotNull()).select(col(text).alias("text"))
    run, schema = _postings(n, num, den, counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = (texts.mapInArrow(run, schema).repartition(parts, "token").sortWithinPartitions("token", "fp")
             .mapInArrow(_shared, LISTS))
    lists = staged(lists, "postings")
    near = [lists.where(F.col("fp") != F.col(k)).where(
        F.lit(den) * F.least("n", f"{k}_n") >= F.lit(num) * F.greatest("n", f"{k}_n"))
        .select(F.least("fp", k).alias("a"), F.greatest("fp", k).alias("b")) for k in ("lead", *(f"back{i}" for i in range(BACK)))]
    stars = staged(reduce(DataFrame.union, near).distinct(), "stars")
    linked, tested = _verify(stars, classes, texts, n, num, den), stars
    label = components(linked)

    def members_of_lists() -> DataFrame:
        """Members of lists of three or more (a list of two is done) with their components."""
        own = lists.where("deep").select("token", "fp", "n", "pos").join(label.withColumnRenamed("node", "fp"), "fp", "left")
        return staged(own.withColumn("label", F.coalesce("label", "fp")), "tagged")

    for _ in range(ROUNDS):
        # Edits give a text n-grams of its own, which stand first in its prefix. The member with most shared ones is the
        # likeliest centre of its list: members of other components meet it, before pairs are tried.
        own = members_of_lists()
        shared = own.groupBy("fp").agg(F.count("*").alias("shared"))
        own = own.join(shared, "fp")
        hub = own.groupBy("token").agg(F.max(F.struct("shared", "fp", "n", "label")).alias("other"))
        near = own.join(hub, "token").where("other.label != label").where(
            F.lit(den) * F.least("n", "other.n") >= F.lit(num) * F.greatest("n", "other.n"))
        near = near.select(F.least("fp", "other.fp").alias("a"), F.greatest("fp", "other.fp").alias("b")).distinct()
        near = staged(near.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        more = _verify(near, classes, texts, n, num, den)
        if more.isEmpty():
            break
        linked, tested = staged(linked.union(more), "linked"), staged(tested.union(near), "tested")
        label = components(linked)

    # Lists that still hold different components; the others are done.
    tagged = members_of_lists()
    mixed = (tagged.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"))
             .where("x != y").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    members = (tagged.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "fp", "n", "pos", "label", "block")
               .join(classes.select("fp", "bins"), "fp").select("token", "low", "high", "fp", "n", "pos", "label", "block", "bins"))
    pairs = (members.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high")
             .mapInArrow(_cross_pairs(num, den), "a bigint, b bigint").distinct())
    pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    more = _verify(pairs, classes, texts, n, num, den)
    return profile.select("doc_id", "text_key", "n", "fp"), components(linked.union(more))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link at ``den * common >= num * union``."""
    profile, label = links(docs, key, text, n, num, den)
    named = profile.where("doc_id IS NOT NULL AND n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = named.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = staged(named.join(groups, "label").select("fp", "component_id", F.lit(1).alias("known")), "groups")
    out = profile.withColumn("fp", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("fp"))).join(groups, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near copies (five words, 0.8): the one with the smallest id, then hash of its text.

    Rows are known by id and text, so an id's other texts stay. Of rows with the same id and text one stays: the one with the
    smallest hash of all its columns. Rows with a null id are no group's and all stay.
    """
    profile, label = links(docs, "doc_id", "text", 5, 80, 100)
    rows = profile.where("doc_id IS NOT NULL").groupBy("doc_id", "text_key", "fp").agg(F.min("n").alias("n"), F.count("*").alias("many"))
    rows = rows.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rows = staged(rows, "near-copies")
    first = rows.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    key, text, name = fresh(docs, "doc_key"), fresh(docs, "text_key"), F.col
    gone = rows.where("n > 0").join(first, "label").where("first != struct(doc_id, text_key)").select("doc_id", "text_key")
    again = rows.where("many > 1").select("doc_id", "text_key")
    this = [name("doc_id") == name(key), F.xxhash64("text") == name(text)]
    rest = docs.join(gone.union(again).toDF(key, text), this, "left_anti")
    once = docs.join(again.join(gone, ["doc_id", "text_key"], "left_anti").toDF(key, text), this, "left_semi")
    once = once.groupBy("doc_id", F.xxhash64("text").alias(text)).agg(
        F.min_by(F.struct(*map(col, docs.columns)), F.xxhash64(*map(col, docs.columns))).alias(key))
    return rest.unionByName(once.select(f"{key}.*"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN list_aggregate(ws, 'string_agg', ' ')
  ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) AS p(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id),
reps AS (SELECT min(doc_id) AS rep FROM sets GROUP BY gs),
one AS (SELECT s.* FROM s JOIN reps ON rep = doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM one x JOIN one y
  ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 90 * (na.n + nb.n - c)
  UNION SELECT min(doc_id) OVER (PARTITION BY gs), doc_id FROM sets),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
