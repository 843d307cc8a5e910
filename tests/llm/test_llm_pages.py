"""Main text of pages: names as hints, unclosed markup in linear time, and tables with hard rows."""

import time

import pytest

from rapport.llm.op7_html import extracted, main_text

TEXT = ("Some text, with commas, and more of it. " * 4).strip()
P = f"<p>{TEXT}</p>"
PAGES = "page_id bigint, url string, html string, main string, MAIN_ string, text string"


def times(n):
    return "\n".join([TEXT] * n)


@pytest.mark.parametrize("page,n", [
    (f"<div class='layout has-sidebar'>{P * 5}<div class=sidebar>{P}</div></div>", 5),
    (f"<div id=page class='hfeed site menu-closed'>{P * 5}<ul class=menu><li>{P}</ul></div>", 5),
    (f"<div class='comment-free content'>{P * 4}</div>", 4),
    (f"<body><form action=x>{P * 4}<div class=ad>{P}</div><input><select><option>{TEXT}</select></form></body>", 4),
    (f"<article>{P * 3}<form>{P}</form></article>", 3),
    (f"<article>{P}<section id=comments>{P * 9}</section></article>", 1),
    (f"<div>{P * 2}</div><div class='comment-body'>{P * 9}</div>", 2),
    (f"<div class=widget>{P * 2}</div>", 2),
    (f"<div class='elementor-widget-theme-post-content'>{P * 3}</div><div class='sidebar-right'>{P}</div>", 3),
    (f"<div class=content-menu-left>{P}</div><div>{P * 3}</div>", 3),
    (f"<div role=navigation>{P * 5}</div><div>{P}</div>", 1),
    (f"<div class=ad>{TEXT}</div><article><h1>{TEXT}</h1></article>", 1),
])
def test_names_are_hints(page, n):
    assert main_text(page) == times(n)


@pytest.mark.parametrize("page,text", [
    ("text <b one <p>x</p>", "text x"), ("a <!-- c", "a"), ("<p>a</p> b <!-- c", "a\nb"), ("1 < 2 and <i>3</i> > 1", "1 < 2 and 3 > 1"),
    ("<a title='a > b'>x</a>", "x"), ("<form><p>a</p><ul><li>b</ul></form>", "a\nb"), ("<p>a</p><!-- <p>b</p> --><p>c</p>", "a\nc")])
def test_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("piece,n", [("<div>x", 100_000), ("<b>x<p>y", 50_000), ("<a b=\"'>x", 100_000), ("<a ", 100_000), ("</a", 100_000),
                                     ("<!", 100_000), ("<ul><li><span>x", 50_000), ("<div>A longer text, with a comma.", 50_000)])
def test_unclosed_markup_takes_linear_time(piece, n):
    start = time.process_time()
    main_text(piece * n)
    assert time.process_time() - start < 5


def test_tables_with_hard_rows(spark):
    long = "<article>" + P * 20_000 + "</article>"
    rows = [(1, "u", None, "m", "n", "t"), (2, None, "", None, None, None), (3, "u", f"<div>{P}</div>", "m", "n", "t"),
            (3, "u", f"<div>{P}</div>", "m", "n", "t"), (None, "u", long, "m", "n", "t"), (4, "u", "<p>\U0001f600 &amp; x</p>", "m", "n", "t")]
    pages = spark.createDataFrame(rows, PAGES)
    done = extracted(pages)
    assert done.columns[:-1] == pages.columns and done.columns[-1] == "main__"
    got = [(r[0], r[3], r[-1].text, r[-1].n_chars) for r in done.collect()]
    want = {None: times(20_000), 1: "", 2: "", 3: TEXT, 4: "\U0001f600 & x"}
    assert sorted(str(g[:2]) for g in got) == sorted(str((r[0], r[3])) for r in rows)
    assert all(g[2] == want[g[0]] and g[3] == len(want[g[0]]) for g in got)
    assert extracted(pages.limit(0)).count() == 0
