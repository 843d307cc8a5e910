"""Language identification with a bit-sliced Bloom filter of n-grams.

One table serves all languages: each slot holds a bit mask of languages. An n-gram's slots, combined with AND, give the
mask of all languages that contain it (and some that do not: false positives). A text's n-grams are counted per language,
the count is corrected for the false positives that the language's fill makes likely, and the largest count decides; the
score is the part of the text's n-grams that the language contains.

Learning: a language contains an n-gram that occurs at least ``MIN_COUNT`` times in its sample and at least ``MIN_RATIO``
times as often as in the language where it is most frequent. The sample is up to ``TRAIN_DOCS`` documents per language,
those with the smallest hash of the id, among documents with a language whose crc32(id) mod 4 is not 2.

N-grams are taken over the bytes of the text; A-Z become small, and runs of ASCII bytes that are not letters become one
space. Texts are read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text without known n-grams gets the
language with most sampled documents (ties: the smallest name) and score 0; equal counts go to the smallest name; without
any labelled document all are ``und``; null ids are never learned from and not held out; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rapport.llm import texts as X
from rapport.llm.bitmaps import SCHEMA, gathered, pieces
from rapport.llm.shared import col, fresh, frugal, staged, table

SIZES = (3, 5)
SLOTS, PROBES = 1 << 20, 2
TRAIN_DOCS, MIN_COUNT, MIN_RATIO = 600, 3, 0.25
#: Bytes of text judged at once; about a hundred bytes of arrays stand for each.
SLICE_BYTES = 1 << 18
#: Pipeline: texts of which less than this part is known to their language go.
MIN_SCORE = 0.3
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_PLAIN[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(rows: X.Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashes of all n-grams of a slice and their rows."""
    data = _PLAIN[rows.data]
    n, count = len(data), len(rows.begin)
    keep = data != 0x20
    keep[1:] |= data[:-1] != 0x20
    head = rows.begin[rows.begin < n]
    keep[head] = data[head] != 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[rows.end] - kept[rows.begin]
    start = np.concatenate([[0], np.cumsum(size + 1)])         # each text begins with one space, and the next one's ends it
    text = np.full(start[-1] + max(SIZES), 0x20, np.uint8)
    row = np.repeat(np.arange(count), size)
    text[np.arange(len(row)) + row + 1] = data[keep]
    owner = np.repeat(np.arange(count), size + 1)
    place = np.arange(start[-1])
    wide = text.astype(np.uint64)
    for k in SIZES:
        value = np.full(len(place), k, np.uint64)
        for j in range(k):
            value = (value << np.uint64(8)) | wide[j:j + len(place)]
        inside = place + k <= start[owner + 1] + 1
        yield X.mixed(value[inside]), owner[inside]


def slots(gram: np.ndarray) -> list[np.ndarray]:
    return [((gram >> np.uint64(20 * j)) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(PROBES)]


def lettered(rows: X.Rows) -> np.ndarray:
    """Whether each text has a letter."""
    def any_in(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[rows.end] > total[rows.begin]

    small = rows.data | 0x20
    found = any_in((small >= ord("a")) & (small <= ord("z")))
    for i in np.flatnonzero(~found & any_in(rows.data >= 0x80)):
        found[i] = any(ch.isalpha() for ch in rows.data[rows.begin[i]:rows.end[i]].tobytes().decode("utf-8", "replace"))
    return found


class Filter:
    """The learned filter: languages, slot masks in slices of 64 languages, and each language's false-positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray, fallback: int):
        self.languages, self.fallback = languages, fallback
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.masks = masks.astype(kind) if len(masks) else np.zeros((1, SLOTS), kind)
        bits = [self._bit(self.masks, i) for i in range(len(languages))]
        self.false = np.array([float(b.mean()) ** PROBES for b in bits])

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)

    def judge(self, rows: X.Rows) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1: none) and its score."""
        count, many = len(rows.begin), len(self.languages)
        total = np.zeros(count)
        hits = np.zeros((count, max(many, 1)))
        for gram, row in grams(rows):
            total += np.bincount(row, minlength=count)
            at = slots(gram)
            for s in range(len(self.masks)):
                mask = self.masks[s][at[0]]
                for more in at[1:]:
                    mask = mask & self.masks[s][more]
                if mask.dtype == np.uint8:
                    by_mask = np.bincount(row * 256 + mask, minlength=count * 256).reshape(count, 256)
                    for i in range(many):
                        hits[:, i] += by_mask[:, (np.arange(256) >> i) & 1 == 1].sum(axis=1)
                else:
                    for i in range(64 * s, min(64 * s + 64, many)):
                        hits[:, i] += np.bincount(row[self._bit(mask[None], i % 64) == 1], minlength=count)
        if not many:
            return np.full(count, -1), np.zeros(count)
        true = np.maximum(hits - total[:, None] * self.false, 0) / np.maximum(1 - self.false, 1e-9)
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(count), best] / np.maximum(total, 1), 0, 1)
        best = np.where(score > 0, best, self.fallback)
        found = lettered(rows)
        return np.where(found, best, -1), np.where(found, score, 0.0)


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _added(total, value: np.ndarray, many: np.ndarray):
    """Counts of n-grams, in order, with more of them."""
    if total is None:
        return value, many
    value, at = np.unique(np.concatenate([total[0], value]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([total[1], many])).astype(np.int64)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Filter:
    labelled = docs.where(col(key).isNotNull() & col(lang).isNotNull() & col(text).isNotNull() & ~held_out(col(key)))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (labelled.select(col(key).alias("id"), col(lang).alias("lang")).withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= train_docs))
    chosen = staged(chosen.groupBy("id").agg(F.min("lang").alias("lang")), "language-sample")
    per = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # a row per language
    languages = sorted(per)
    if not languages:
        return Filter([], np.zeros((0, SLOTS), np.uint64), -1)
    index = {name: i for i, name in enumerate(languages)}

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}                              # of this task's part of the sample, which is bounded
        for batch in batches:
            own = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for rows in X.slices(batch.column(0)):
                for gram, row in grams(rows):
                    at = own[rows.first + row]
                    for i in np.unique(at).tolist():
                        total[i] = _added(total.get(i), *np.unique(gram[at == i], return_counts=True))
        for i, (value, many) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(np.full(len(value), i, np.int32)), pa.array(many)], ["gram", "ix", "n"])

    # The sample is bounded: TRAIN_DOCS ids per language.
    sample = labelled.select(col(key).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "lang")
    names = [f"n{i}" for i in range(len(languages))]
    counts = sample.mapInArrow(count, "gram bigint, ix int, n bigint").groupBy("gram").agg(
        *[F.coalesce(F.sum(F.when(F.col("ix") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(names)])
    counts = staged(counts, "language-grams")
    totals = np.maximum(np.array(counts.agg(*[F.coalesce(F.sum(name), F.lit(0)) for name in names]).first(), float), 1)
    deep, kind = -(-len(languages) // 64), (np.uint8 if len(languages) <= 8 else np.uint64)

    @frugal
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros((deep, SLOTS), kind)
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            many = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            part = many / totals
            known = (many >= MIN_COUNT) & (part >= MIN_RATIO * part.max(axis=1, keepdims=True))
            for i in range(len(languages)):
                for at in slots(gram[known[:, i]]):
                    masks[i // 64, at] |= kind(1 << (i % 64))
        yield pieces(masks.ravel())

    masks = gathered(counts.coalesce(4).mapInArrow(mark, SCHEMA), np.bitwise_or, kind, deep * SLOTS)
    fallback = max(languages, key=lambda name: (per[name], [-ord(c) for c in name]))
    return Filter(languages, masks.reshape(deep, SLOTS), index[fallback])


def predicted(docs: DataFrame, model: Filter, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred and score. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @frugal
    def judge(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*shared.value.languages, "und"], object)
        for batch in column:
            parts = [shared.value.judge(rows) for rows in X.slices(batch, SLICE_BYTES)]
            best = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    return docs.withColumn(into, judge(col(text)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised, with their own columns."""
    name = fresh(docs, "language")
    found = predicted(docs, learned(docs), into=name)
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= MIN_SCORE)).select(*[col(c) for c in docs.columns])


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learned(docs)
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
