"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks of text. A block is described by its word count and link
density, by those of the block before and of the block after, by whether it is a heading, and by
one weak hint of where it stands; a decision tree that is trained on the labelled table below
tells main text from the rest. The page is read once from left to right, in time that grows with
its length however broken it is.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_HINTS = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Elements that stand in a line of text, that have no end, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas xmp".split())
#: Elements around an article, and names of parts of a page.
AROUND = frozenset("nav footer aside menu button select option dialog fieldset datalist head".split())
NEVER = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor comment comments disqus respond reply replies cookie cookies consent gdpr footer sidebar nav navbar navigation menu breadcrumb breadcrumbs newsletter subscribe signup".split())
OUTSIDE = frozenset("header masthead banner promo promotion notice notices alert popup modal overlay share sharing social related recommended widget subscription login register copyright legal toolbar pagination pager skip search form tags complementary contentinfo aside".split())
INSIDE = frozenset("article post entry story content main body text".split())
#: Names of reader comments. Within an article other ids name its sections: one on cookies, on a menu, on a reply.
REMARKS = frozenset("comment comments disqus respond".split())
#: Last parts of a name that say nothing of their own, and parts that turn a name into something else.
HOLDERS = frozenset("list area box wrapper wrap container section block slot bar left right inner outer top bottom links buttons posts items unit group row col column panel region thread meta info".split())
SWITCHES = frozenset("with without no has not hide show is layout".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose open one a new one ends, up to the element that bounds it.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "body": (("head",), ("html",)), "option": (("option",), ("select", "datalist"))}

#: The columns of the labelled table. place: 2 in an article or main element, 1 in something called so, 0 unknown,
#: -1 in something with a name that often stands around articles, -2 in an element around them or in adverts and comments.
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading")
_LONG, _TEXT, _SHORT, _MENU, _CLOUD, _NONE = (80, 0.0), (35, 0.05), (6, 0.0), (2, 1.0), (80, 0.95), (0, 0.0)


def _labelled() -> np.ndarray:
    """The labelled table, a row a block: ``COLUMNS``, then 1 for main text."""
    rows = []

    def label(is_main: int, place: int, blocks, around, heading: int = 0) -> None:
        rows.extend((*b, *before, *after, place, heading, is_main) for b in blocks for before, after in around)

    prose = [(_LONG, _LONG), (_LONG, _TEXT), (_TEXT, _LONG), (_TEXT, _TEXT)]
    beside_one = [(_LONG, _MENU), (_MENU, _LONG), (_TEXT, _NONE), (_NONE, _TEXT)]
    menus = [(_MENU, _MENU), (_NONE, _MENU), (_MENU, _NONE), (_SHORT, _MENU), (_MENU, _SHORT), (_CLOUD, _MENU), (_CLOUD, _CLOUD), (_MENU, _CLOUD), (_NONE, _CLOUD)]
    # Inside an article most is main text: headings, one-word lines, references; but no run of short links.
    inside = [(_LONG, _LONG), (_SHORT, _SHORT), (_MENU, _NONE), (_NONE, _MENU)]
    label(1, 2, [(1, 0.0), (8, 0.0), (40, 0.1), (200, 0.0), (3, 1.0), (9, 1.0)], inside)
    label(1, 2, [(1, 0.0), (8, 0.0), (40, 0.1), (200, 0.0), (9, 1.0), (14, 0.9)], [(_MENU, _MENU), (_CLOUD, _CLOUD)])
    label(0, 2, [(1, 1.0), (2, 1.0), (4, 1.0)], [(_MENU, _MENU), (_LONG, _MENU), (_MENU, _LONG), (_TEXT, _MENU), (_MENU, _TEXT), (_SHORT, _MENU), (_MENU, _SHORT)])
    label(1, 2, [(9, 0.0), (2, 0.0)], [(_MENU, _LONG), (_LONG, _LONG)], heading=1)
    # Something only called content: prose and what stands in it, but no link lists.
    label(1, 1, [(60, 0.0), (25, 0.1), (8, 0.0), (1, 0.0)], prose + beside_one)
    label(1, 1, [(7, 0.0)], [(_NONE, _NONE), (_SHORT, _SHORT), (_NONE, _SHORT), (_SHORT, _NONE)])
    label(1, 1, [(5, 1.0)], prose)
    label(1, 1, [(6, 0.0)], [(_MENU, _LONG), (_NONE, _LONG), (_LONG, _TEXT)], heading=1)
    label(0, 1, [(2, 1.0), (6, 0.9), (12, 0.95)], menus)
    # Nothing known: text by its length and its neighbours.
    label(1, 0, [(60, 0.0), (120, 0.1)], prose + beside_one + menus)
    label(1, 0, [(28, 0.0)], prose + beside_one)
    label(1, 0, [(8, 0.0), (12, 0.0)], prose)
    label(1, 0, [(6, 0.0), (10, 0.0)], [(_MENU, _LONG), (_NONE, _LONG), (_SHORT, _LONG), (_LONG, _TEXT)], heading=1)
    label(0, 0, [(8, 0.0), (3, 0.0)], menus + [(_SHORT, _SHORT), (_NONE, _NONE), (_SHORT, _NONE), (_NONE, _SHORT)])
    label(0, 0, [(4, 0.0)], [(_LONG, _MENU), (_LONG, _NONE), (_MENU, _MENU)])
    label(0, 0, [(2, 1.0), (6, 0.8), (25, 0.9)], menus + beside_one + [(_TEXT, _MENU)])
    label(0, 0, [(4, 0.0)], [(_MENU, _MENU), (_LONG, _MENU)], heading=1)
    # A name of something around: only prose beside prose outweighs it.
    label(1, -1, [(45, 0.0), (90, 0.05)], prose + beside_one)
    label(0, -1, [(45, 0.0), (90, 0.05)], menus + [(_SHORT, _SHORT), (_NONE, _NONE)])
    label(0, -1, [(6, 0.0), (15, 0.1), (3, 1.0), (30, 0.8)], prose + beside_one + menus)
    label(0, -1, [(4, 0.0)], [(_MENU, _TEXT), (_LONG, _MENU)], heading=1)
    label(0, -2, [(1, 1.0), (8, 0.0), (45, 0.0), (90, 0.05), (150, 0.0)], [(_LONG, _LONG), (_TEXT, _TEXT), (_SHORT, _SHORT), (_MENU, _MENU), (_TEXT, _NONE)])
    label(0, -2, [(5, 0.0)], [(_MENU, _TEXT), (_LONG, _LONG)], heading=1)
    return np.array(rows, float)


LABELLED = _labelled()


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """A CART tree by Gini impurity: a leaf is its share of ones, a node (column, threshold, low, high)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (len(y) * 2 * share * (1 - share) - 1e-9, None, None)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= cut
            worth = sum(part.sum() * 2 * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if worth < best[0]:
                best = (worth, c, cut)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.cache
def trained():
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def judge(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _says(token: str) -> int:
    """What one class, id or role says: -2, -1, 0 or 1 as ``place``.

    The last part that is no holder counts: site-footer is a footer, comment-list comments,
    social-history a history; with-sidebar and no-sidebar are switches and say nothing.
    """
    parts = [p.lower() for p in _PARTS.findall(token)]
    if SWITCHES.intersection(parts):
        return 0
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    if not parts:
        return 0
    head, before = parts[-1], set(parts[:-1])
    if head in INSIDE:
        return 0 if before & (NEVER | OUTSIDE) else 1
    return -2 if head in NEVER else -1 if head in OUTSIDE else 0


def _place(name: str, attributes: str, above: int) -> int:
    """The place of what an element holds: its own hint, or else that of the element around it."""
    if name in AROUND:
        return -2
    if name in ("article", "main"):
        return 2
    if attributes:
        if _HIDDEN.search(attributes):
            return -2
        if name not in ("body", "html"):
            said = {_says(t) for kind, *v in _HINTS.findall(attributes) for t in "".join(v).split() if kind.lower() != "id" or above < 2 or REMARKS.intersection(p.lower() for p in _PARTS.findall(t))}
            if 1 in said and min(said) >= -1:
                return max(above, 1)
            if min(said, default=0) < 0:
                # What is named as no article within one is meant.
                return -2 if above == 2 else min(said)
    if name == "header" and above < 1 or name == "form" and above < 2:
        return min(above, -1)
    if name == "form":
        return -1
    return above


def blocks(page: str | None) -> list[tuple]:
    """(text, words, link density, place, heading, part) of each flat block that has text, in page order.

    ``part`` numbers the outermost elements of place -2 on the page; it is 0 for blocks of other places.
    """
    page = page or ""
    out: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # name, place, in a heading, part
    parts = 0
    is_open: dict[str, int] = {}
    in_link = False

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n_linked = len(html.unescape(" ".join(linked)).split())
                out.append((" ".join(words), len(words), min(1.0, n_linked / len(words)), stack[-1][1], int(stack[-1][2]), stack[-1][3]))
        text, linked = [], []

    def add(part: str) -> None:
        if part:
            text.append(part)
            if in_link:
                linked.append(part)

    def pop() -> str:
        name = stack.pop()[0]
        is_open[name] -= 1
        return name

    at, last, plain, closers = 0, page.rfind(">"), False, {}
    while (i := page.find("<", at)) >= 0:
        add(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            end = len(page) if end < 0 else end
            add(html.escape(page[i + 9 : end]))
            at = end + 3
            continue
        m = _NAME.match(page, i + 1)
        if m is None or i > last:
            if page[i + 1 : i + 2] in ("!", "?", "/") and page.find(">", i) >= 0:
                at = page.find(">", i) + 1
            elif m is not None:
                at = len(page)  # a tag that never ends
            else:
                add("<")
                at = i + 1
            continue
        # The end of the tag: the next > outside quotes. A page on which a quote stays open has its tags end at any >.
        end = m.end() if not plain else page.find(">", m.end())
        while not plain:
            s = _STOP.search(page, end)
            if s is None:
                plain, end = True, page.find(">", m.end())
            elif s[0] == ">":
                end = s.start()
                break
            else:
                end = page.find(s[0], s.end()) + 1
                if not end:
                    plain, end = True, page.find(">", m.end())
        at = end + 1
        name, closing, attributes = m[1].lower(), page[i + 1] == "/", page[m.end() : end]
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img"):
                text.append(" ")
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, at)
                at = len(page) if close is None else close.end()
            continue
        flush()
        in_link = False
        if closing:
            if is_open.get(name):
                while pop() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if stack[-1][0] == "p":  # a block ends an open paragraph
            pop()
        alike, bounds = _ENDS.get(name, ((), ()))
        if any(is_open.get(n) for n in alike):
            k = len(stack) - 1
            while k and stack[k][0] not in alike and stack[k][0] not in bounds:
                k -= 1
            if k and stack[k][0] in alike:
                while len(stack) > k:
                    pop()
        place, part = _place(name, attributes, stack[-1][1]), 0
        if place == -2:
            part = stack[-1][3] or parts + 1
            parts = max(parts, part)
        stack.append((name, place, stack[-1][2] or name in _HEADINGS, part))
        is_open[name] = is_open.get(name, 0) + 1
    add(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main blocks in page order, joined by a line feed; empty if there are none.

    Where the hints of all text say that it is none of the article, and words and links alone find
    main text in a single part of the page, its hint says nothing and these decide. Where they find
    it in several parts, as in a menu, comments and an aside, each is what it is called.

    >>> main_text("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two</article>")
    'A & B\nOne two'
    """
    own = blocks(page)
    kept = chosen(own)
    if not kept and own and all(b[3] == -2 for b in own if b[2] < 0.5):
        unnamed = chosen([(*b[:3], 0, *b[4:]) for b in own])
        kept = unnamed if len({b[5] for b in unnamed}) == 1 else []
    return "\n".join(b[0] for b in kept)


def chosen(own: list[tuple]) -> list[tuple]:
    """The blocks that the tree takes for main text."""
    none = ("", 0, 0.0, 0, 0, 0)
    rows = zip([none, *own], own, [*own[1:], none])
    return [b for before, b, after in rows if judge(trained(), (b[1], b[2], before[1], before[2], after[1], after[2], b[3], b[4])) >= 0.5]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html, and pages without a main block, have the empty text. Pages of any
    length are read whole, broken ones as far as they go. Repeated rows give a row each, null
    ids and urls stay null, an empty table gives no rows; extra columns are dropped.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
ORACLES: dict = {}
