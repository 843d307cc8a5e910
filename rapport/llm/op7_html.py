"""Main text of web pages by scores over the element tree.

A page is read once into a light tree; elements that never hold main text (menus, headers, footers, asides, scripts, and
those whose role or hiding attribute says so) are left out with all they hold. Class names and ids are hints: an element
named an advert, a notice, comments and the like is left out unless no text would be left without it; a form, and one
whose name only mentions such a thing (``has-sidebar``, ``menu-closed``, ``comment-free``, ``widget-post-content``) stays
where it holds most of the page's paragraphs. Each remaining block of text is a paragraph: it earns points for its length and its commas, less the part of it that
is link text, and passes them to its parent, half of them to the next ancestor, a quarter to the one above. The container
with most points wins; one within an article or main element stands for that element. From there the choice climbs to the
element that holds all paragraphs with points that are not mostly links (all in articles, where the winner is in one). Of
what lies in it and among its siblings only what is mostly links goes, and no heading; length and share decide nothing.

The text is the blocks of what is kept, in page order: references decoded, white space inside a block made one space,
trimmed, joined by ``\\n``. Nothing else is dropped and nothing is cut.

Defined results: null or empty html, or a page without text, gives ''; without any paragraph that earns points all blocks
that are left are kept; among equal containers the first opened wins; repeated rows are alike; unclosed and misnested tags,
comments and scripts without end are read as browsers do, roughly; the time is linear in the page, whatever is unclosed.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm.shared import col, fresh, table

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
#: Elements without main text.
OUTSIDE = frozenset("""head nav footer aside script style noscript template iframe svg math button select textarea input
dialog object audio video canvas menu search title""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids, and whole ones, that name what is not main text.
PARTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments
disqus respond replies cookie cookies consent gdpr notice newsletter subscribe subscription signup share sharing social related
recommended breadcrumb breadcrumbs menu nav navbar navigation navigator pagination pager popup modal overlay footer toolbar widget
masthead login popover lightbox skip hidden""".split())
NAMES = frozenset("header site-header page-header top-header global-header top topbar top-bar banner site-banner".split())
#: Parts beside which such a name describes a state or a layout, and those that say that main text is inside. Comments are
#: known by their name whatever holds their text.
STATES = frozenset("""has with no not without is are free closed open opened collapsed expanded enabled disabled active inactive off on
left right wide full layout""".split())
INSIDE = frozenset("content article post entry body text story main".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: An element in doubt stays from this part of the page's paragraphs on.
MOST = 0.5
#: Points: for a paragraph of this length, for every 100 characters up to a number, for each comma.
LEAST, PER_100, COMMA = 25, 3, 1
#: From this part of link text on, what lies beside the best container is links, not main text.
LINKED = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<(?:(!--)|([a-zA-Z][^\s/>]*)|/([a-zA-Z][^\s/>]*)|[!?])")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$|[a-z])", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile("[,،、，]")


#: What speaks against an element: nothing, a name in doubt, a plain name, or that it never holds main text.
CLEAR, DOUBT, NAMED, OUT = range(4)


class Node:
    __slots__ = ("tag", "up", "order", "out", "against", "block", "points", "chars", "link_chars", "held_chars", "article")

    def __init__(self, tag: str, up: "Node | None", against: int, order: int):
        self.tag, self.up, self.order, self.against = tag, up, order, against
        self.out = against == OUT or up is not None and up.out
        self.block = self if up is None or tag in BLOCKS else up.block
        self.points = 0.0
        self.chars = self.link_chars = self.held_chars = 0
        self.article = self if tag in ("article", "main") else up.article if up else None


def named(name: str) -> int:
    """What one class name or id says about an element."""
    parts = {p.lower() for p in _PART.findall(name)}
    if name.lower().replace("_", "-") in NAMES:
        return NAMED
    if not parts & PARTS:
        return CLEAR
    return DOUBT if parts & STATES or parts & INSIDE and not parts & COMMENTS else NAMED


def against(tag: str, attributes: str) -> int:
    """What class, id, role or a hiding attribute says about an element."""
    found = DOUBT if tag == "form" else CLEAR
    if tag in ("html", "body", "main") or not attributes:
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value.lower() == "true":
            return OUT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
        if key == "role" and value.lower() in ROLES:
            found = max(found, DOUBT if value.lower() == "form" else OUT)
        elif key in ("class", "id"):
            names = [named(name) for name in value.split()]
            # Among several names of one element a plain one decides, and one that says that main text is inside casts doubt.
            inside = any(name.lower() in INSIDE for name in value.split())
            found = max([found, *(DOUBT if inside and n == NAMED else n for n in names)])
    return found


def blocks(page: str) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """(text, element, link characters) of every block of text outside of what never holds main text, in page order, and
    all elements, parents before children."""
    root = Node("", None, CLEAR, 0)
    here, opened, found, nodes = root, {}, [], [root]
    text: list[str] = []
    links: list[str] = []
    in_link = 0
    at = 0
    scan, last, token = len(page), page.rfind(">") + 1, _TOKEN.search
    unclosed = {"'": scan, '"': scan}      # from here on a quote of this kind has no partner

    def flush(owner: Node) -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                found.append((whole, owner, len(" ".join("".join(links).split()))))
            text.clear()
            links.clear()

    def tag_end(i: int) -> int:
        """Where a tag's ``>`` is that lies in no quoted value; -1 without any."""
        while i < last:
            i = _PLAIN.match(page, i).end()
            if i >= last or page[i] == ">":
                break
            quote = page[i]
            closing = page.find(quote, i + 1) if i < unclosed[quote] else -1
            if closing < 0:
                unclosed[quote] = min(unclosed[quote], i)
                return -1
            i = closing + 1
        return i if i < last else -1

    def close(tag: str) -> None:
        nonlocal here, in_link
        while True:
            name = here.tag
            if name in BLOCKS:
                flush(here)
            in_link -= name == "a"
            opened[name] -= 1
            here = here.up
            if name == tag:
                return

    def said(piece: str) -> None:
        if not here.out and piece:
            if "&" in piece:
                piece = entities.unescape(piece)
            text.append(piece)
            if in_link:
                links.append(piece)

    while at < scan:
        # Text runs up to the next token that is one: a "<" whose tag has no end is text.
        start, end, match = at, -1, None
        while end < 0:
            match = token(page, start, last)
            if not match:
                break
            if match[1]:
                end = page.find("-->", match.end())
                end = scan if end < 0 else end + 2
            elif match[2]:
                end = tag_end(match.end())
            else:
                end = page.find(">", match.end())
            start = match.end()
        if not match:
            tail = page.find("<!--", max(at, last))          # a comment without end, behind the last tag
            said(page[at:tail] if tail >= 0 else page[at:])
            break
        said(page[at:match.start()])
        attributes = page[match.end():end]
        at = end + 1
        _, tag, ending = match.groups()
        if tag:
            tag = tag.lower()
            if tag in ("br", "hr", "img", "input") and not here.out:
                text.append(" ")
            if tag in VOID:
                if tag == "hr":
                    flush(here.block)
                continue
            if tag in RAW:
                done = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = (page.find(">", done.end()) + 1 or scan) if done else scan
                continue
            if tag in BLOCKS:
                if opened.get("p"):
                    close("p")
                elif not here.out:
                    flush(here.block)
                for same, within in (("li", ("ul", "ol", "menu")), ("td", ("tr", "table")), ("th", ("tr", "table")),
                                     ("tr", ("table",)), ("dt", ("dl",)), ("dd", ("dl",)), ("option", ("select",))):
                    if opened.get(same) and (tag == same or {tag, same} in ({"td", "th"}, {"dt", "dd"}) or tag == "tr" and same in ("td", "th")):
                        node = here
                        while node.tag and node.tag != same and node.tag not in within:
                            node = node.up
                        if node.tag == same:
                            close(same)
            if tag in OUTSIDE or tag == "header" and here.article is None:
                level = OUT
            else:
                level = CLEAR if tag == "article" and here.article is None else against(tag, attributes)
            here = Node(tag, here, level, len(nodes))
            nodes.append(here)
            opened[tag] = opened.get(tag, 0) + 1
            in_link += tag == "a"
        elif ending:
            ending = ending.lower()
            if opened.get(ending):
                close(ending)
            elif ending == "br" and not here.out:
                text.append(" ")
    flush(here.block)
    return found, nodes


def paragraph(size: int, links: int) -> bool:
    """Whether a block is long enough for points and not mostly link text."""
    return size >= LEAST and links < LINKED * size


def without_named(found: list[tuple[str, Node, int]], nodes: list[Node]) -> list[tuple[str, Node, int]]:
    """The blocks less those in elements that their names speak against.

    Elements in doubt stay where they hold most of the paragraphs (of all text, on a page without paragraphs) outside of
    plainly named elements; these stay where there is no text without them.
    """
    plain = [False]
    for node in nodes[1:]:
        plain.append(plain[node.up.order] or node.against == NAMED)
    texts = [(element, len(whole), paragraph(len(whole), links)) for whole, element, links in found if links < LINKED * len(whole)]
    outside = [b for b in texts if not plain[b[0].order]]
    measured = outside or texts
    if any(long for _, _, long in measured):
        measured = [b for b in measured if b[2]]
    for element, size, _ in measured:
        element.held_chars += size
    for node in reversed(nodes[1:]):
        node.up.held_chars += node.held_chars
    least = max(MOST * nodes[0].held_chars, 1)
    gone = [False]
    for node in nodes[1:]:
        small = node.held_chars < least
        gone.append(gone[node.up.order] or small and node.against in (DOUBT, NAMED) or bool(outside) and node.against == NAMED)
    return [b for b in found if not gone[b[1].order]]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found, nodes = blocks(page)
    found = without_named(found, nodes)
    best, good = None, []
    for whole, element, links in found:
        size = len(whole)
        points = 0.0
        if size >= LEAST:
            points = (1 + min(size / 100, PER_100) + COMMA * len(_COMMAS.findall(whole))) * (1 - min(links / size, 1))
        if points > 0 and paragraph(size, links):
            good.append(element)
        node, share = element.up or element, 1.0
        for _ in range(3):
            if node is None:
                break
            node.points += points * share
            node, share = node.up, share / 2
        element.chars += size
        element.link_chars += links
    for node in reversed(nodes):
        if node.up is not None:
            node.up.chars += node.chars
            node.up.link_chars += node.link_chars
    for node in nodes:
        value = node.points * (1 - node.link_chars / max(node.chars, 1))
        if node.tag and value > 0 and (best is None or value > best[0]):
            best = (value, node)
    if best is None:
        return "\n".join(whole for whole, _, _ in found)
    inner = best[1]
    while inner.article is not None and inner.article is not inner:
        inner = inner.article
    line, place = [], {}
    node = inner
    while node is not None:
        place[node.order] = len(line)
        line.append(node)
        node = node.up
    # Climb to where all paragraphs of the main text meet; where articles are marked, those outside of them have no say.
    meets: list[int] = []
    for node in nodes:
        meets.append(place[node.order] if node.order in place else meets[node.up.order])
    level, held = 0, set(place)
    for element in good:
        if inner.article is None or element.article is not None:
            level = max(level, meets[element.order])
        node = element
        while node.order not in held:
            held.add(node.order)
            node = node.up
    top = line[level]
    while top.article is not None and top.article is not top:
        top = top.article
    while top.article is None and top.up is not None and top.up.chars == top.chars:
        top = top.up
    # Of every element: the nearest of the chosen ones that it lies in, and the branch without paragraphs that it is part of.
    stops = {inner.order, top.order} | ({top.up.order} if top.up is not None else set())
    within: list[int | None] = []
    branch: list[Node | None] = []
    for node in nodes:
        up = node.up.order if node.up is not None else None
        within.append(node.order if node.order in stops else None if up is None else within[up])
        branch.append(None if node.order in held else branch[up] or node)

    def kept(whole: str, element: Node, links: int) -> bool:
        stop, part = within[element.order], branch[element.order]
        if stop is None:
            return False
        if stop == inner.order or element.tag in HEADINGS and part in (element, None):
            return True
        return links < LINKED * len(whole) if part is None else part.link_chars < LINKED * part.chars

    return "\n".join(whole for whole, element, links in found if kept(whole, element, links))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` and one more column, the last: a struct of text and n_chars (code points). It is called ``main``, with
    underscores behind where that name is taken; no other column changes."""
    @F.arrow_udf("struct<text:string,n_chars:bigint>")
    def extract(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            texts = [main_text(page.as_py()) for page in batch]
            yield pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    return pages.withColumn(fresh(pages, "main"), extract(col(html)))


def op7_html(spark, sf_dir: str) -> DataFrame:
    pages = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "main.text", "main.n_chars")
