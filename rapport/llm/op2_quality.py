"""Quality rules on repetition: a suffix array over the words of each text.

The suffix array is built by prefix doubling for many texts at once; the rank arrays of the doublings give the longest
common prefix of neighbours. A suffix's deepest LCP interval is the longest substring that starts there and occurs again
in the same text; the spans of these maximal repeats are united. A text is kept when the repeats of ``min_repeat`` words
or more cover at most ``max_covered`` of its words and none is longer than ``max_repeat`` words.

Defined results: a null or empty text has no words and fails the base rule; null ids, ties, repeated rows and extra
columns pass through row by row, since each text is judged alone. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm import texts as X
from rapport.llm.shared import col, fresh, frugal, table

#: Shortest repeat that counts, most of a text that repeats may cover, and longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.2, 50
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_ranks(keys: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many sequences laid end to end, and the ranks after each doubling.

    ``keys``: a symbol of each position, different between sequences; ``last``: one past the end of the position's
    sequence. Ranks at level k agree where two suffixes share their first 2**k symbols.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    arranged = keys[order]
    heads = np.concatenate([[True], arranged[1:] != arranged[:-1]])
    place = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    levels = [rank.astype(np.int32)]
    step = 1
    shared = ~heads
    shared[:-1] |= ~heads[1:]
    active = np.flatnonzero(shared)          # places in the order whose suffix is not yet told apart
    while len(active):
        at = order[active]
        beyond = at + step
        second = np.where(beyond < last[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        inner = np.argsort(pair, kind="stable")
        pair, at = pair[inner], at[inner]
        order[active] = at
        heads = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank = rank.copy()
        rank[at] = active[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        step *= 2
        shared = ~heads
        shared[:-1] |= ~heads[1:]
        active = active[shared]
    return order, levels


def longest_repeats(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs again in its sequence."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    order, levels = suffix_ranks(keys, last)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < last[a]) & (y < last[b])
        ranks = levels[k]
        same = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
        common += same * (1 << k)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, spans: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of the spans of at least ``least`` symbols."""
    n = len(longest)
    start = np.flatnonzero(longest >= least)
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + spans[start], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def measures(rows: X.Rows, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text in a slice."""
    n = len(rows.begin)
    begin, end, row = X.words(rows)
    head = np.cumsum(X.per_row(row, n))
    last = head[row]
    keys = X.mixed(X.hashes(rows.data, begin, end) + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    longest = longest_repeats(keys, last)
    whole = ((rows.data & 0xC0) != 0x80) & ~X._SPACE[rows.data]
    chars = np.concatenate([[0], np.cumsum(whole)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[rows.data])])
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, longest)
    first = np.concatenate([[0], row[1:] != row[:-1]]).astype(bool)
    maximal = longest >= min_repeat
    maximal[1:] &= first[1:] | (longest[1:] != longest[:-1] - 1)
    three = np.full(len(longest), 3)

    from_line, to_line, line_row = X.lines(rows)
    letters = np.concatenate([[0], np.cumsum(~X._SPACE[rows.data])])
    filled = letters[to_line] > letters[from_line]
    from_line, to_line, line_row = from_line[filled], to_line[filled], line_row[filled]
    line = X.mixed(X.hashes(rows.data, from_line, to_line) + line_row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, kept = np.unique(line, return_index=True)
    return {
        "n_words": X.per_row(row, n),
        "word_chars": chars[rows.end] - chars[rows.begin],
        "n_symbols": symbols[rows.end] - symbols[rows.begin],
        "n_dup_lines": X.per_row(line_row, n) - X.per_row(line_row[kept], n),
        "n_repeat_words": X.per_row(row[covered(longest, three, 3)], n),
        "covered_words": X.per_row(row[covered(longest, longest, min_repeat)], n),
        "n_repeats": X.per_row(row[maximal], n),
        "longest_repeat": most,
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "n_repeats",
            "longest_repeat"]


def repetition(text, min_repeat: int = MIN_REPEAT):
    """Column: struct of the counts in ``MEASURES`` for a text column."""
    kind = "struct<" + ",".join(f"{name}:bigint" for name in MEASURES) + ">"

    @F.arrow_udf(kind)
    @frugal
    def count(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            parts = [measures(rows, min_repeat) for rows in X.slices(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64))
                 for name in MEASURES], MEASURES)

    return count(text)


def judged(docs: DataFrame, text: str = "text", into: str = "quality", min_repeat: int = MIN_REPEAT,
           max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct column ``into``: the counts, ``base_failed`` and ``kept``."""
    raw = fresh(docs, "repetition")
    q = F.col(raw)
    failed = (q.n_words < min_words) | (100 * q.n_repeat_words > 50 * q.n_words)
    kept = ~failed & (q.covered_words <= F.lit(float(max_covered)) * q.n_words) & (q.longest_repeat <= max_repeat)
    return (docs.withColumn(raw, repetition(col(text), min_repeat))
            .withColumn(into, F.struct(*[q[m].alias(m) for m in MEASURES], failed.alias("base_failed"), kept.alias("kept")))
            .drop(raw))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns."""
    name = fresh(docs, "quality")
    return judged(docs, into=name).where(F.col(name)["kept"]).select(*[col(c) for c in docs.columns])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols",
                               "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept",
                               "quality.covered_words")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, sum(n - 1) AS n_dup_lines FROM (SELECT rid, line, count(*) AS n FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
windows AS (SELECT rid, k, i, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS win
  FROM w, (VALUES (3), ({MIN_REPEAT}), ({MAX_REPEAT + 1})) sizes(k), unnest(range(1, len(ws) - k + 2)) AS p(i)),
again AS (SELECT rid, k, i FROM (SELECT rid, k, i, count(*) OVER (PARTITION BY rid, k, win) AS n FROM windows) WHERE n > 1),
cover AS (SELECT rid, k, count(DISTINCT i + j) AS words FROM again, unnest(range(0, k)) AS o(j) GROUP BY rid, k),
m AS (SELECT d.doc_id, len(ws) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words,
  coalesce(cm.words, 0) AS covered_words, coalesce(cx.words, 0) AS over_long
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid)
  LEFT JOIN cover c3 ON c3.rid = d.rid AND c3.k = 3 LEFT JOIN cover cm ON cm.rid = d.rid AND cm.k = {MIN_REPEAT}
  LEFT JOIN cover cx ON cx.rid = d.rid AND cx.k = {MAX_REPEAT + 1})
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= {MAX_COVERED} * n_words
   AND over_long = 0) AS kept, covered_words
FROM m"""
