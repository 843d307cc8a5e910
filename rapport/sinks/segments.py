"""Text index kept beside an archive, in segments.

An import batch adds one segment: lists of postings in order of term, and what questions filter by, a row per memory. A
list holds a term's postings in a block of memories (``BLOCK`` tokens, so no list grows with the corpus) and their counts; a
task tokenises its memories once, counts block by block and writes its lists where it is, without a shuffle. Numbers that
add up over segments, memories and tokens in all, are in the manifest. A search asks it which segments are live, reads only
the asked terms of each (a file is in order of term, so its other pages are skipped by their statistics) and scores as over
one index. Merging writes several segments as one of fewer files, again without a shuffle. The manifest is written last, so
a segment or a merge that broke off is not read (every segment has a folder of its own, and files of live ones never change);
a batch that is replayed gets a new segment in place of its old one, or leaves things alone when a merge has taken it up.

One writer at a time (the feed). Memories are insert-only, so a segment never loses a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport.functions.topics import stem, words
from rapport.operators import resolution as R
from rapport.operators import retrieval as S
from rapport.session import at_most

#: Asked terms up to this many go to the scan as a list (some ten kilobytes); more are joined.
LITERALS = 2_000
#: Live segments of one size class (powers of FANOUT in tokens) that are merged into one.
FANOUT = 8
MANIFEST = "version bigint, segment string, batches array<bigint>, docs bigint, tokens bigint"
#: Tokens behind one list of postings and in one step of the counting; a longer text is a block of its own.
BLOCK = 1_000_000
LISTS = "term string, df bigint, occurrences bigint, ids array<string>, tfs array<int>, lens array<int>"
DOCS = "id string, person_id string, source string, kind string, occurred_at timestamp_ntz"


def _next(live: list) -> int:
    return max((s.version for s in live), default=0) + 1


def _block(ids: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    """The lists of a block of memories, in order of term."""
    coded = tokens.flatten().dictionary_encode()
    by_term = pc.array_sort_indices(coded.dictionary)
    terms = coded.dictionary.take(by_term)
    rank = np.empty(len(terms), dtype=np.int64)
    rank[by_term.to_numpy()] = np.arange(len(terms))
    lens = np.diff(tokens.offsets.to_numpy())
    pairs, tfs = np.unique(rank[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), lens), return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    starts = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.int32)
    occurrences = np.diff(np.concatenate([[0], np.cumsum(tfs)])[starts])
    columns = [terms, pa.array(np.diff(starts).astype(np.int64)), pa.array(occurrences.astype(np.int64))] + [
        pa.ListArray.from_arrays(pa.array(starts), values)
        for values in (ids.take(pa.array(doc)), pa.array(tfs.astype(np.int32)), pa.array(lens[doc].astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, names=["term", "df", "occurrences", "ids", "tfs", "lens"])


def _lists(batches):
    """Lists of the memories (id, tokens) of a task, block by block."""
    for batch in batches:
        ids, tokens = batch.columns
        ends = tokens.offsets.to_numpy()[1:].astype(np.int64) - tokens.offsets[0].as_py()
        at = 0
        while at < len(ids):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            yield _block(ids.slice(at, to - at), tokens.slice(at, to - at))
            at = to


def _postings(lists: DataFrame) -> DataFrame:
    return lists.select("term", "tfs", "lens", F.posexplode("ids").alias("_at", "id")).select(
        "id", "term", F.get("tfs", "_at").cast("bigint").alias("tf"), F.get("lens", "_at").cast("bigint").alias("doc_len"))


class TextIndex:
    """Segments under ``root``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def live(self) -> list:
        """Manifest rows of the live segments; at most FANOUT per size class."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException:
            return []
        last = rows.agg(F.max("version")).first()[0]
        return sorted(rows.where(F.col("version") == last).collect(), key=lambda r: r.segment)

    def _publish(self, version: int, segments: list[tuple]) -> None:
        """(segment, batches, docs, tokens) of all that is live from now on."""
        self.spark.createDataFrame([(version, *s) for s in segments], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _write(self, segment: str, lists: DataFrame) -> None:
        """Each task's lists in order of term; no list changes its task."""
        lists.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.root}/{segment}/lists")

    def append(self, corpus: DataFrame, batch: int) -> None:
        """Index a batch's memories (columns as in :mod:`rapport.operators.retrieval`)."""
        live = self.live()
        if any(batch in s.batches and len(s.batches) > 1 for s in live):
            return                                              # replayed after a merge took it up
        version = _next(live)
        segment = f"batch-{batch}-v{version}"
        kept = [(F.col(c) if c in corpus.columns else F.lit(None)).cast("timestamp_ntz" if c == "occurred_at" else "string").alias(c)
                for c in (*S.FILTERS, "occurred_at")]
        corpus.select(F.col("id").cast("string").alias("id"), *kept).write.mode("overwrite").parquet(f"{self.root}/{segment}/docs")
        tokens = F.transform(words(S.index_text(corpus)), stem)
        self._write(segment, corpus.select(F.col("id").cast("string").alias("id"), tokens.alias("tokens")).mapInArrow(_lists, LISTS))
        docs = self._read([segment], "docs", DOCS).count()
        tokens = self._read([segment], "lists", LISTS).agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).first().n
        self._publish(version, [tuple(s)[1:] for s in live if s.batches != [batch]] + [(segment, [batch], docs, tokens)])

    def _read(self, segments: list[str], part: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s}/{part}" for s in segments])

    def lists(self) -> DataFrame:
        return self._read([s.segment for s in self.live()], "lists", LISTS)

    def docs(self) -> DataFrame:
        """What questions filter by, a row per memory."""
        return self._read([s.segment for s in self.live()], "docs", DOCS)

    def size(self) -> DataFrame:
        """One row: number of memories and their mean length in tokens."""
        live = self.live()
        docs, tokens = sum(s.docs for s in live), sum(s.tokens for s in live)
        return self.spark.createDataFrame([(docs, tokens / docs if docs else None)], "docs bigint, avg_len double")

    def term_counts(self) -> DataFrame:
        """(term, df, occurrences): how many memories hold a term and how often it stands in them."""
        return self.lists().groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))

    def merge(self, batches: list[int] | None = None) -> str | None:
        """Make one segment of several: those of the given batches, or all of a size class that holds FANOUT. Hits
        stay as they are."""
        live = self.live()
        if batches is not None:
            names = [s.segment for s in live if set(s.batches) & set(batches)]
        else:
            classes: dict[int, list] = {}
            for s in live:
                level, size = 0, s.tokens
                while size >= FANOUT:
                    level, size = level + 1, size // FANOUT
                classes.setdefault(level, []).append(s.segment)
            names = next((c for _, c in sorted(classes.items()) if len(c) >= FANOUT), [])
        taken = [s for s in live if s.segment in names]
        if len(taken) < 2:
            return None
        batches = sorted(b for s in taken for b in s.batches)
        version = _next(live)
        merged = f"merged-v{version}"
        names = [s.segment for s in taken]
        self._read(names, "docs", DOCS).write.mode("overwrite").parquet(f"{self.root}/{merged}/docs")
        # Spark reads small files together; what a task reads becomes one file in order of term.
        self._write(merged, self._read(names, "lists", LISTS))
        self._publish(version, [tuple(s)[1:] for s in live if s.segment not in names] + [
            (merged, batches, sum(s.docs for s in taken), sum(s.tokens for s in taken))])
        return merged

    def asked_lists(self, questions: DataFrame) -> DataFrame:
        """Lists of the questions' terms; nothing else leaves the scan."""
        terms = S.question_terms(questions).select("term").distinct()
        some = [r.term for r in terms.limit(LITERALS + 1).collect()]
        if len(some) > LITERALS:
            return self.lists().join(F.broadcast(terms) if at_most(terms, S.BROADCAST_TERMS) else terms, "term", "left_semi")
        if int(self.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) < LITERALS:
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LITERALS))
        return self.lists().where(F.col("term").isin(some))

    def asked(self, questions: DataFrame) -> DataFrame:
        """(id, term, tf, doc_len): postings of the questions' terms."""
        return _postings(self.asked_lists(questions))

    def search(self, questions: DataFrame, k: int = 12, merges: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best memories per question. ``merges`` (old_id, new_id) re-points the
        people that questions ask for."""
        lists = self.asked_lists(questions)
        index = _postings(lists)
        if {*S.FILTERS, "after"} & {*questions.columns}:
            docs = self.docs()
            index = index.join(docs if merges is None else R.repoint(docs, merges).drop("moved"), "id")
        counts = lists.groupBy("term").agg(F.sum("df").alias("df"))
        return S.keyword_search(questions, None, k, index=index, size=self.size(), counts=counts)


def indexed(spark: SparkSession, root: str, parts: list[DataFrame]) -> TextIndex:
    """An index of several batches, one segment each."""
    index = TextIndex(spark, root)
    for batch, part in enumerate(parts):
        index.append(part, batch)
    return index
