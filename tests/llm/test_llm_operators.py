"""The training-data operators against brute force, the libraries they must equal, and hard cases."""

import hashlib
import html
import itertools
import os
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module", autouse=True)
def tables():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not on this machine")


def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", "b"), (3, base + " sixteen", "en", None), (4, None, "en", "a"),
            (5, "", None, "a"), (6, " \n\t ", "en", "b"), (None, base, "en", "a"), (7, long, "de", "c"), (8, long + " end", None, "c"),
            (9, "é", "fr", "a"), (10, "123 456", "fr", "a"), (11, "a b", "en", "a"), (12, "A  B", "en", "a"), (13, "b a", None, None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def with_clashes(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in ("quality", "language", "mix", "main", "pieces", "repetition", "turn_", "licences")])


# -- quality rules ----------------------------------------------------------------------

def brute_repeats(words):
    """Longest repeat from each position, by trying all pairs."""
    n = len(words)
    out = [0] * n
    for i, j in itertools.permutations(range(n), 2):
        k = 0
        while i + k < n and j + k < n and words[i + k] == words[j + k]:
            k += 1
        out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_repeats(seed):
    from rapport.llm.op2_quality import longest_repeats

    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, k, n).tolist() for k, n in ((2, 40), (3, 60), (1, 17), (50, 30), (5, 0), (2, 1))]
    keys = np.array([t * 1000 + w for t, words in enumerate(texts) for w in words], np.uint64)
    ends = np.cumsum([len(w) for w in texts])
    last = np.repeat(ends, [len(w) for w in texts])
    assert longest_repeats(keys, last).tolist() == [x for words in texts for x in brute_repeats(words)]


def test_quality_hard_cases(spark):
    from rapport.llm import op2_quality as Q

    docs = with_clashes(hard_docs(spark))
    rows = Q.judged(docs, into="q").select("doc_id", "text", "q.*").collect()
    assert len(rows) == 15
    for r in rows:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
    kept = Q.stage(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {7, 8}
    assert Q.stage(spark, docs.limit(0), SF).count() == 0
    line = "alpha beta gamma delta " * 20
    bad = spark.createDataFrame([(1, line)], "doc_id bigint, text string")
    assert not Q.judged(bad).first().quality.kept


# -- language ------------------------------------------------------------------------------

def test_language_accuracy_and_hard_cases(spark):
    from rapport.llm import op1_language as G

    rows = G.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = rows.where("held_out AND lang IS NOT NULL").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    docs = with_clashes(hard_docs(spark))
    model = G.learned(spark.read.parquet(f"{SF}/documents.parquet"))
    found = {r.doc_id: r.p for r in G.predicted(docs, model, into="p").collect()}
    assert found[4].lang_pred == found[5].lang_pred == found[10].lang_pred == "und" and found[10].score == 0
    assert found[9].lang_pred in model.languages and 0 <= found[1].score <= 1
    assert G.stage(spark, docs, SF).columns == docs.columns
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.p.lang_pred for r in G.predicted(nobody, G.learned(nobody), into="p").collect()} == {"und"}


def test_language_filter_has_no_false_negatives():
    from rapport.llm import op1_language as G

    rng = np.random.default_rng(1)
    gram = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    masks = np.zeros((1, G.SLOTS), np.uint8)
    for at in G.slots(gram):
        masks[0, at] |= 2
    model = G.Filter(["a", "b"], masks, 0)
    got = masks[0][G.slots(gram)[0]] & masks[0][G.slots(gram)[1]]
    assert (got == 2).all() and model.false[0] == 0 and 0 < model.false[1] < 1e-3


# -- near copies ---------------------------------------------------------------------------

def sets(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_components(rows, n, num, den):
    """Smallest id reachable, by comparing all pairs."""
    own = [(i, sets(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(own, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in parent}


def copies(seed, groups=12, most=14):
    """Texts with chains of small edits, so that links do not all meet in one document."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(string.ascii_lowercase), 4)) for _ in range(300)]
    out, key = [], 100
    for _ in range(groups):
        text = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, most))):
            text = list(text)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            out.append((key, " ".join(text)))
            key += 1
    rng.shuffle(out)
    return [(int(i), str(t)) for i, t in out]


@pytest.mark.parametrize("n,num,block", [(3, 90, 4096), (5, 80, 4096), (3, 90, 4), (2, 70, 3)])
def test_join_equals_brute_force(spark, monkeypatch, n, num, block):
    from rapport.llm import op10_ngram_join as J

    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "AT_ONCE", 50)
    rows = copies(n * num)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in J.joined(docs, n=n, num=num).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_join_hard_cases(spark):
    from rapport.llm import op10_ngram_join as J

    docs = with_clashes(hard_docs(spark))
    rows = J.joined(docs, n=3, num=90).collect()
    assert len(rows) == 15
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[None] == (13, None) and got[2] == (13, 1) and got[3] == (14, 1) and got[4] == (0, 4) and got[6] == (0, 6)
    assert got[12] == (1, 11) and got[13] == (1, 13) and got[8][1] == 7
    kept = J.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 10, 11, 13]
    assert J.joined(docs.limit(0)).count() == 0


def test_stage_decides_by_row(spark):
    """An id with several texts loses only those that are near copies; no group vanishes; reruns agree."""
    from rapport.llm import op10_ngram_join as J

    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a, "x"), (2, a + " end", "x"), (2, b, "x"), (3, b + " end", "x"), (2, b, "y"), (2, b, "w"), (4, c, "x"), (4, "other " + b[:9], "x"), (5, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string").repartition(4)
    kept = sorted((r.doc_id, r.text or "") for r in J.stage(spark, docs, SF).collect())
    assert kept == sorted([(1, a), (2, b), (4, c), (4, "other " + b[:9]), (5, ""), (5, "")])
    again = J.stage(spark, docs.repartition(3), SF)
    assert again.columns == docs.columns and again.exceptAll(J.stage(spark, docs, SF)).count() == 0


def test_shared_postings_stream():
    """Any cutting of the stream into batches gives the same lists."""
    import pyarrow as pa

    from rapport.llm.op10_ngram_join import BACK, _shared

    rng = np.random.default_rng(3)
    rows = sorted({(int(t), int(f)) for t, f in zip(rng.zipf(1.5, 400) % 60, rng.integers(0, 40, 400))})
    rows = sorted(rows + rows[::7])
    table = [np.array(c) for c in zip(*[(t, f, f + 5, t % 4) for t, f in rows])]

    def run(cuts):
        edges = [0, *cuts, len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in table], ["token", "fp", "n", "pos"])
                   for a, b in zip(edges, edges[1:])]
        return [tuple(r.values()) for b in _shared(iter(batches)) for r in b.to_pylist()]

    lists = {t: sorted({f for u, f in rows if u == t}) for t, _ in rows}
    want = [(t, f, f + 5, t % 4, own[0], own[0] + 5,
             *[x for b in range(1, BACK + 1) for x in (own[max(k - b, 0)], own[max(k - b, 0)] + 5)], len(own) > 2)
            for t, own in sorted(lists.items()) if len(own) > 1 for k, f in enumerate(own)]
    for seed in range(20):
        cuts = sorted(np.random.default_rng(seed).integers(0, len(rows) + 1, seed).tolist())
        assert sorted(run(cuts)) == want


def test_components(spark):
    from rapport.llm.components import components

    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 80, (60, 2)) if a != b]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


# -- mixing ----------------------------------------------------------------------------------

def test_mixing(spark):
    from rapport.llm import op4_mixing as M

    docs = with_clashes(hard_docs(spark))
    done = M.mixed(docs)
    rows = done.select("doc_id", "source", F.col(done.columns[-1]).alias("m")).collect()
    assert len(rows) == 15
    total = sum(r.m.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.m.copies <= 3 and r.m.taken == r.m.copies * r.m.size and r.m.target <= 3 * r.m.source_size
        by.setdefault(r.source, [r.m.target, 0, r.m.source_size])[1] += r.m.taken
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6 * total
    assert by["a"][0] == 3 * by["a"][2]
    kept = M.stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == sum(r.m.copies for r in rows)
    assert M.mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    from rapport.llm import op4_mixing as M

    rows = M.op4_mixing(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 0.03 * r.w for r in per)
    again = M.op4_mixing(spark, "/root/testdata/sf0.01")
    assert again.exceptAll(M.op4_mixing(spark, "/root/testdata/sf0.01").repartition(7)).count() == 0


def test_mixing_with_repeated_ids(spark):
    """Other texts under one id, or under null, are taken one by one; exact repeats are charged as a whole."""
    from rapport.llm import op4_mixing as M

    text = lambda tag, i, n: " ".join(f"{tag}{i}x{j}" for j in range(n))
    rows = [(7, text("a", i, 10), "a") for i in range(200)] + [(1000 + i, text("b", i, 37), "a") for i in range(400)]
    rows += [(None, text("c", i, 12), "b") for i in range(400)] + [(5000 + i, text("d", i, 25), "b") for i in range(300)]
    rows += [(9, "same words here", "c")] * 5 + [(6000 + i, text("e", i, 9), "c") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    done = M.mixed(docs)
    per = done.groupBy("source").agg(F.sum(F.col(done.columns[-1]).taken).alias("t"), F.first(F.col(done.columns[-1]).target).alias("w"))
    assert all(abs(r.t - r.w) <= 0.01 * r.w for r in per.collect())
    assert M.mixed(docs.repartition(3)).exceptAll(done).isEmpty()


# -- vectors -----------------------------------------------------------------------------------

def clustered(seed, width=24):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(width) for _ in range(150)]
    for _ in range(8):
        centre = rng.standard_normal(width)
        out += [centre + rng.standard_normal(width) * rng.uniform(0.05, 0.3) for _ in range(25)]
    out += [out[0], out[160] * 3]
    return np.array(out, np.float32)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    from rapport.llm import op5_near_vectors as V

    monkeypatch.setattr(V, "BLOCK", block)
    x = clustered(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {r.vec_id: r for r in V.near_vectors(rows).collect()}
    y = x.astype(float)
    cosine = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    near = cosine >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.95 * near.sum() > 0
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
    assert sum(got[i].component_id == label[i] for i in range(len(x))) >= 0.98 * len(x)
    assert got[0].n_links >= 1 and got[len(x) - 2].component_id == 0


def test_vectors_hard_cases(spark):
    from rapport.llm import op5_near_vectors as V

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e38, 0.0]), (12, [-1.0, 0.0])]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == 14 and by[1].n_links == by[9].n_links == by[11].n_links == 4
    assert {by[i].component_id for i in (1, 2, 9, 11)} == {1} and not by[2].kept
    assert all(by[i].n_links == 0 and by[i].kept and by[i].component_id == i for i in (3, 4, 5, 6, 7, 8, 10, 12))
    assert by[None].component_id is None and by[None].kept
    assert V.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    from rapport.llm import op5_near_vectors as V

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T
    off = ~np.eye(400, dtype=bool)
    error = np.zeros(true.shape)
    for k in range(8):
        turned = x @ V.rotation(64, k)
        factor = np.abs(turned).sum(axis=1) / 8
        got = V.estimates(turned, np.sign(turned), factor)
        error += (got - true) / 8
        assert (np.abs(got - true) <= 5 * V.errors(factor, 64)[:, None])[off].mean() > 0.9999
    assert abs(error[off].mean()) < 0.002


# -- pages ----------------------------------------------------------------------------------------

def test_main_text_of_test_pages(spark):
    from rapport.llm.op7_html import op7_html

    rows = op7_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; text", "plain & text"),
    ("<div id='menu'><a href=x>Home</a></div><div><h1>Title</h1><p>" + "Some text, with commas, and more of it. " * 4 + "</p></div>",
     "Title\n" + ("Some text, with commas, and more of it. " * 4).strip()),
    ("<article><h1>T</h1><p>First, <b>bold\n <i>text</i></b><br>next&nbsp;line<p>second &lt;p&gt; paragraph, long enough to count"
     "<aside>side</aside><form>f</form><div class='cookie-notice'>n</div><script>var s='</p>';</script><section id=comments>"
     "<p>A reader says, at length, that this, and that, is so, again and again.</p></section></article><footer>end</footer>",
     "T\nFirst, bold text next line\nsecond <p> paragraph, long enough to count"),
    ("<!-- open comment <p>x</p>", ""), ("<p>a<p>b<script>never closed <p>c", "a\nb"),
    ("<main><table><tr><td>one cell, with some text in it</td><td>two</td></tr></table></main><nav>menu</nav>",
     "one cell, with some text in it\ntwo"),
])
def test_main_text(page, text):
    from rapport.llm.op7_html import main_text

    assert main_text(page) == text


def test_main_text_is_whole_without_article():
    """Split, short and list-only articles keep all their text; lists of links go."""
    from rapport.llm.op7_html import main_text

    long = [f"Paragraph {i} goes on, with commas, and on, for as long as paragraphs of articles do." for i in range(18)]
    ps = ["".join(f"<p>{p}</p>" for p in part) for part in (long[:10], long[10:])]
    links = "".join(f"<li><a href=/{i}>Some other page of this site, number {i}</a></li>" for i in range(9))
    rows = [f"<div class=row><div class=col>{p}</div></div>" for p in ps]
    assert main_text(f"<body><ul>{links}</ul><div id=content>{''.join(rows)}</div></body>") == "\n".join(long)
    beside = f"<div><h4>Part</h4><p>Short one.</p><ul><li>bread</li><li>salt</li></ul><div>{ps[0]}</div><div><p>{long[11]}</p></div></div>"
    assert main_text(beside) == "\n".join(["Part", "Short one.", "bread", "salt", *long[:10], long[11]])
    assert main_text(f"<body><h1>T</h1><div><div>{ps[0]}</div></div><div><ul>{links}</ul></div></body>") == "\n".join(["T", *long[:10]])
    both = f"<body><article>{ps[0]}</article><article>{ps[1]}</article></body>"
    assert main_text(both) == "\n".join(long)
    assert main_text("<div><ul><li>bread</li><li>salt</li></ul></div>") == "bread\nsalt"


# -- archives -------------------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    from rapport.llm import op9_warc as A

    big = "x" * 150
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4
    rows = [(1, "http://b.example.org/x?q=1#f", big), (2, "http://a.example.org/", big), (3, None, None), (4, "http://a.example.org/y z", "short"),
            (5, "http://a.example.org/y\r\nz", "short"), (None, "http://c.org", big), (6, "http://c.org", tricky), (6, "http://c.org", tricky),
            (7, "not a url", "é" * 60), (8, "http://[bad", "é" * 60), (9, "http://b.example.org", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = A.archived(pages, folder=str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    for i, _, body in rows:
        data = (body or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert (by[2].record_type, by[2].refers_to) == ("revisit", 1) and (by[8].record_type, by[8].refers_to) == ("revisit", 7)
    assert all(by[i].record_type == "response" for i in (1, 3, 4, 5, 6, 7, 9, None)) and sum(r.page_id == 6 for r in got) == 2
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys) and by[1].url_key == "org,example,b)/x?q=1"
    empty = A.archived(pages.limit(0), folder=str(tmp_path / "e"))
    assert empty.count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    from rapport.llm.op9_warc import LoserTree

    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 30, int(rng.integers(0, 20))).tolist()) for _ in range(k)]
    merged = list(LoserTree([iter([(v, (v, i)) for v in run]) for i, run in enumerate(runs)]))
    assert merged == sorted((v, i) for i, run in enumerate(runs) for v in run)


# -- SentencePiece --------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from rapport.llm import op8_sentencepiece as S

    if not os.path.exists(S.MODEL):
        pytest.skip("no model file")
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  a", "a  ", "\n\n x", "été ▁ x", "日本語 テスト", "a\tb\r\nc", "🙂🙂 ok", "a" * 50, "the" * 5000, "a\x00b",
              "----====----", "1234567890" * 5, "ﬁ é é", "m².x ².", "x.com/y?z=1&w=2", "»—.« ”.", None]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, pieces string")
    done = S.encoded(docs, into="own").select("doc_id", "text", "own.*").withColumn("back", S.decoder(spark)(F.col("ids")))
    for r in done.collect():
        if r.text is None:
            assert r.ids is None and r.back is None
        else:
            assert r.ids == library.encode(r.text) and r.back == r.text.replace("▁", " ") and r.round_trip
            assert r.n_pieces == len(r.ids) and r.n_bytes == sum(library.is_byte(i) for i in r.ids)
    assert S.encoded(docs.limit(0), into="own").count() == 0


def test_light_paths_are_shortest():
    from rapport.llm import op8_sentencepiece as S

    rng = np.random.default_rng(0)
    pieces = ["<unk>", "<s>", "</s>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "ba", "aab", "▁a", "bb"]
    scores = [0.0] * 259 + (-rng.uniform(1, 9, 8)).tolist()
    kinds = [2, 3, 3] + [6] * 256 + [1] * 8
    machine = S.Transducer(S.Model(pieces, scores, kinds, False, True))
    cost = dict(zip(pieces, [-s for s in scores]))

    def cheapest(text):
        if not text:
            return 0.0
        return min((cost[text[:k]] + cheapest(text[k:]) for k in range(1, 4) if text[:k] in machine.known), default=float("inf"))

    for _ in range(60):
        text = "▁" + "".join(rng.choice(list("ab"), int(rng.integers(1, 9))))
        assert abs(sum(machine.weight[i] for i in machine.encode(text)) - cheapest(text)) < 1e-9


# -- chat ---------------------------------------------------------------------------------------------

def brute_repair(roles):
    """Least cost over all choices of role, merge and empty messages, tried one by one."""
    from rapport.llm import op6_chat as C

    best = float("inf")
    for choice in itertools.product(range(12), repeat=len(roles)):
        state, cost = C.START, 0
        for role, k in zip(roles, choice):
            moves = C.MOVES[role]
            fit = [m for m in moves if m[1] == state]
            if k >= len(fit):
                cost = float("inf")
                break
            cost, state = cost + fit[k][0], fit[k][2]
        if cost < best:
            best = min(best, cost + C.END[state])
    return best


def test_repair_is_cheapest():
    from rapport.llm import op6_chat as C

    for roles in itertools.chain.from_iterable(itertools.product(range(4), repeat=n) for n in (1, 2, 3)):
        total = C.product([C.STEPS[r] for r in roles])
        leave = C.best_end(total)
        cost = total[C.START, leave] + C.END[leave]
        moves = C.decoded(list(roles), C.START, leave)
        assert cost == brute_repair(roles) == sum(m[0] for m in moves) + C.END[moves[-1][2]]


def legal(roles):
    from rapport.llm import op6_chat as C

    state = C.START
    for r in roles:
        if C.ROLES.index(r) not in C.AFTER[state]:
            return False
        state = C.ROLES.index(r)
    return state == C.ASSISTANT


@pytest.mark.parametrize("bits", [8, 1])
def test_chat_repair(spark, monkeypatch, bits):
    from rapport.llm import op6_chat as C

    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    monkeypatch.setattr(C, "BLOCK", 1 << bits)
    rng = np.random.default_rng(9)
    names = ["system", "user", "assistant", "tool", None, " User "]
    rows = [(c, t, names[int(rng.integers(0, 6))], f"t{c}.{t}") for c in range(12) for t in range(int(rng.integers(1, 30)))]
    rows += [(50, None, "user", "late"), (50, 3, "user", None), (50, 3, "user", None), (50, -7, "assistant", "x"), (None, 1, "assistant", "n")]
    rows += [(60, t, "user", "u") for t in range(40)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turn_", F.lit(1))
    got = C.repaired(turns).collect()
    for conv in {r[0] for r in rows}:
        pieces = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.block, r.seq))
        whole = "".join(r.piece for r in pieces)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert legal(roles) and whole.count("<|end|>\n") == len(roles)
        order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or ""))
        at = 0
        for r in order:
            if r[3]:
                at = whole.index(r[3], at) + len(r[3])
        codes = C.codes([r[2] for r in order])
        total = C.product([C.STEPS[r] for r in codes])
        end = C.best_end(total)
        spent = sum({"keep": 0, "merge": C.MERGE, "relabel": C.RELABEL, "merge+relabel": C.MERGE + C.RELABEL, "insert": C.INSERT, "end": 0}[r.action] for r in pieces)
        assert spent == total[C.START, end] + C.END[end]
    assert C.repaired(turns.limit(0)).count() == 0


def test_chat_blocks_are_bounded(spark):
    """Many rows of one turn, without turn or without conversation go into blocks of ``BLOCK`` rows, in their order."""
    from rapport.llm import op6_chat as C

    rows = [(conv, turn, "user" if i % 2 else "assistant", f"t{i:05d}") for conv, turn in ((None, 0), (None, None), (1, 5), (1, 6)) for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = [r for r in C.repaired(turns).collect() if r.action not in ("insert", "end")]
    for conv in (None, 1):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.block, r.seq))
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        assert [r.piece[-6:] for r in own] == [r[3] for r in want]
        per = {}
        for r in own:
            per[r.block] = per.get(r.block, 0) + 1
        assert per == {k: min(C.BLOCK, 1400 - k * C.BLOCK) for k in range(6)}


# -- licences ---------------------------------------------------------------------------------------

def test_licences(spark):
    from rapport.llm import op3_licenses as L

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    negatives = L.sample(docs, "doc_id", "text")
    model = L.trained(negatives, 8)
    rng = np.random.default_rng(4)
    foreign = sorted({w for p in negatives[:50] for w in p.split()})
    texts, label = L.disturbed(foreign, 4, rng)
    at, row, _ = L.counts(texts)
    found = L.probabilities(model.logits(at, row, len(texts)), model.temperature)
    assert (found[:, :L.UNKNOWN].argmax(axis=1) == np.array(label)).mean() > 0.97
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "nothing of the kind here"), (3, None), (4, ""), (None, "Licensed under CC BY-NC 4.0."),
            (5, "This work is licensed under the GNU General Public License, version 3.\n" * 2)]
    hard = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("licences", F.lit("x"))
    got = {r.doc_id: [f.family for f in r.own.found] for r in L.scanned(hard, into="own", model=model).collect()}
    assert got == {1: ["mit"], 2: [], 3: [], 4: [], None: ["cc-by-nc"], 5: ["gpl", "gpl"]}
    clean = L.scanned(docs, into="own", model=model).where(~F.lower("text").rlike("licen|copyright|public domain|rights reserved")).where(F.size("own.found") > 0)
    assert clean.count() == 0


def test_licences_wrapped_and_embedded(spark):
    """Notices broken over lines, within longer lines, and identifiers by their short names."""
    import textwrap

    from rapport.llm import op3_licenses as L

    model = L.trained(L.sample(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    bsd, gpl = L.TEMPLATES["bsd"][0], L.TEMPLATES["gpl"][1]
    wrap = lambda text, width, mark: "\n".join(mark + x for x in textwrap.wrap(text, width))
    noise = " ".join(f"qword{i}" for i in range(200))
    rows = [(1, "x = 1\n\n" + wrap(bsd, 72, "# ") + "\n\ny = 2"), (2, wrap(gpl, 40, " * ")), (3, f"{noise} {bsd} {noise}"),
            (4, "SPDX-License-Identifier: GPL-2.0-only"), (5, f"{noise}\n{noise}"), (6, wrap(bsd, 72, "") + "\n\n" + wrap(bsd, 60, ""))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = {r.doc_id: [f.family for f in r.own.found] for r in L.scanned(docs, into="own", model=model).collect()}
    assert got == {1: ["bsd"], 2: ["gpl"], 3: ["bsd"], 4: ["gpl"], 5: [], 6: ["bsd", "bsd"]}
