"""Operator 6: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and a line's length counts what could
be article text: not menus, headers, footers, sidebars, notices, adverts, forms or comments. The
sums of these lengths over sliding windows of lines surge where the article begins and dive where it ends.
The scope of an article is the element that holds what surges: a marked one where the page marks its article,
else the innermost that holds nearly all of it. What stands in the scope between a surge and its dive is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: A window's length at a surge, or this share of the page's longest window if that is less.
SURGE, SURGE_SHARE = 86, 0.3
#: Without a marked article: the share of the surging lines' length that the scope holds.
SCOPE = 0.9
#: Share of a line's length in links from which it is a menu entry, outside a marked article.
LINKS = 0.6
#: An element whose names call it boilerplate, but that holds more than this share of the page's text, isn't.
MOST = 0.5
# Elements whose content is no text, that end a block, that hold others, and that have no end.
RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video xmp".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div section article main aside nav header footer form ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr figure figcaption address details summary fieldset legend body html head center menu dialog".split())
CONTAINERS = BLOCKS | {"a", "span", "button"}
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
MARKS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER = frozenset("nav footer aside form menu dialog head button header".split())
# Words in a class, id or role that name such parts: of comments; of others, as first or last word of a name; as its only word.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
PARTS = frozenset("ad ads adv advert advertisement sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar widget widgets cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social related recommended recommendations login signup search toolbar pagination pager complementary contentinfo alert alertdialog aside".split())
ALONE = frozenset("side dialog notification message form".split())
# Words before "header" that make it the article's own, and words of names that tell of a state.
OWN = frozenset("post entry article story content section page blog news".split())
STATES = frozenset("has have with without no not is open opened closed enabled disabled by".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_named = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""(?<![\w-])hidden(?![\w-])(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_word = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

NONE, NAMED, ELEMENT, COMMENT, OWN_HEADER = range(5)


def _kind(element: str, attributes: str) -> int:
    """What an element's name, and its class, id and role, say that it is."""
    kind = NONE
    if attributes and element not in ("body", "html"):
        if _hidden.search(attributes):
            kind = NAMED
        for found in _named.findall(attributes):
            for name in "".join(found).split():
                words = [w.lower() for w in _word.findall(name)]
                if not words or not STATES.isdisjoint(words):
                    continue
                if words[-1] == "header" and len(words) > 1 and words[-2] in OWN:
                    return OWN_HEADER
                if not COMMENTS.isdisjoint(words):
                    return COMMENT
                if words[0] in PARTS or words[-1] in PARTS or (len(words) == 1 and words[0] in ALONE):
                    kind = NAMED
    if element in BOILER:
        return NAMED if element in ("form", "header") else ELEMENT
    return kind


class _Line:
    __slots__ = ("element", "heading", "linked", "parts", "text")

    def __init__(self, element: int, heading: bool) -> None:
        self.parts: list[str] = []
        self.linked, self.element, self.heading, self.text = 0, element, heading, ""


class Page:
    """A page's elements, numbered as they begin so that those inside one are the numbers up to its ``last``, and its lines."""

    def __init__(self, page: str) -> None:
        self.parent, self.kind, self.mark, self.name = [-1], [NONE], [False], [""]
        self.lines: list[_Line] = []
        self._read(page)
        n = len(self.parent)
        self.last = list(range(n))
        self.mass = [0] * n
        for line in self.lines:
            line.text = " ".join("".join(line.parts).split())
            self.mass[line.element] += max(0, len(line.text) - line.linked)
        self.lines = [x for x in self.lines if x.text]
        self.marks = [int(m) for m in self.mark]  # marked elements inside, itself included, but for comments
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            self.last[p] = max(self.last[p], self.last[e])
            self.mass[p] += self.mass[e]
            if self.kind[e] == COMMENT:
                self.marks[e] = 0
            self.marks[p] += self.marks[e]
        self._judge()

    def _judge(self) -> None:
        """``boiler`` and ``inside`` (a marked article) for each element, from the outermost."""
        total = self.mass[0]
        self.boiler, self.inside, self.own = [False], [False], [False]
        self.outer = [-1]  # the outermost marked element around each, itself included
        for e in range(1, len(self.parent)):
            p, kind = self.parent[e], self.kind[e]
            self.outer.append(self.outer[p] if self.outer[p] >= 0 or not self.mark[e] else e)
            inner_marks = self.marks[e] - self.mark[e]
            if kind == OWN_HEADER or (kind == NAMED and self.name[e] == "header" and self.inside[p]):
                says, own = True, True
            else:
                own = False
                says = kind == COMMENT or (kind == ELEMENT and not (inner_marks and 2 * self.mass[e] > total)) or (kind == NAMED and not inner_marks and self.mass[e] <= MOST * total)
            self.boiler.append(self.boiler[p] or says)
            self.own.append((own and not self.boiler[p]) or (self.own[p] and not says))
            self.inside.append(not self.boiler[e] and (self.inside[p] or self.mark[e]))

    def _read(self, page: str) -> None:
        stack, opened, heading = [0], Counter(), 0
        now = _Line(0, False)

        def begin(element: int) -> None:
            nonlocal now
            if now.parts:
                self.lines.append(now)
            now = _Line(element, heading > 0)

        def take(text: str) -> None:
            if text:
                text = html.unescape(text)
                now.parts.append(text)
                if opened["a"]:
                    now.linked += len(text.strip())

        at, n = 0, len(page)
        while at < n:
            m = _token.search(page, at)
            if not m:
                take(page[at:])
                break
            take(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "p":
                    begin(stack[-1])
                elif opened[name]:  # an end that nothing began is passed over
                    block = False
                    while True:
                        e = stack.pop()
                        closed = self.name[e]
                        opened[closed] -= 1
                        heading -= closed in HEADINGS
                        block = block or closed in BLOCKS or closed == "button"
                        if closed == name:
                            break
                    if block:
                        begin(stack[-1])
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
                continue
            if name == "br":
                now.parts.append(" ")
                continue
            if name not in CONTAINERS or name in VOID:
                if name in BLOCKS:
                    begin(stack[-1])
                continue
            e = len(self.parent)
            self.parent.append(stack[-1])
            self.kind.append(_kind(name, m[3]))
            self.mark.append(name in MARKS)
            self.name.append(name)
            if name == "p":
                begin(e)
                continue
            if not m[3].endswith("/"):
                stack.append(e)
                opened[name] += 1
                heading += name in HEADINGS
            if name in BLOCKS or name == "button":
                begin(e)
            elif not "".join(now.parts).strip() and self.kind[e]:
                now.element = e
        if now.parts:
            self.lines.append(now)


def main_text(source: str | None) -> str:
    """The article of a page, its blocks joined by empty lines; empty for null, empty or text-less pages.

    Ends that nothing began are passed over, elements that don't end last to the end of one around them, and the time grows with the page's length.
    """
    page = Page(source or "")
    lines = page.lines
    marked = any(page.inside[x.element] for x in lines)
    length = []
    for x in lines:
        e = x.element
        article = (x.heading and page.own[e]) or not page.boiler[e]
        if marked:
            article = article and (page.inside[e] or page.own[e])
        elif x.linked > LINKS * len(x.text):
            article = False
        length.append(len(x.text) if article else 0)
    n = len(length)
    sums = [sum(length[i : i + WINDOW]) for i in range(n)]
    most = max(sums, default=0)
    if not most:
        return ""
    surge = min(SURGE, SURGE_SHARE * most)
    # from where text begins to the dive, where a whole window has none; what never surges is no article
    regions, i = [], 0
    while i < n:
        if not length[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        if max(sums[i:j]) >= surge:
            regions.append((i, j))
        i = j
    keep = [k for i, j in regions for k in range(i, j) if length[k]]
    if marked:
        # a short line far from the rest stands in the same marked article as what surges
        scopes = {page.outer[lines[k].element] for k in keep}
        keep = [k for k in range(n) if length[k] and page.outer[lines[k].element] in scopes]
    else:
        keep = _in_scope(page, keep, length)
    return "\n\n".join(lines[k].text for k in keep)


def _in_scope(page: Page, keep: list[int], length: list[int]) -> list[int]:
    """Of an unmarked page's surging lines those in the innermost element that holds nearly all of their text, and the headings right before it."""
    held = Counter()
    total = 0
    for k in keep:
        held[page.lines[k].element] += length[k]
        total += length[k]
    within = dict(held)
    for e in range(len(page.parent) - 1, 0, -1):
        if e in within:
            p = page.parent[e]
            within[p] = within.get(p, 0) + within[e]
    inner: dict[int, int] = {}
    for e, size in within.items():
        if e and size >= SCOPE * total and page.name[e] not in HEADINGS and page.name[e] not in ("p", "li", "blockquote", "pre", "a", "span"):
            inner[page.parent[e]] = e
    scope = 0
    while scope in inner:
        scope = inner[scope]
    lo, hi = scope, page.last[scope]
    inside = [k for k in keep if lo <= page.lines[k].element <= hi]
    if not inside or not scope:
        return keep
    first = inside[0]
    while first and length[first - 1] and page.lines[first - 1].heading:
        first -= 1
    return [*range(first, inside[0]), *inside]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for each row.

    Null and empty pages have empty text. Repeated rows and null keys are each kept; other
    columns are left out, whatever their names; an empty table gives an empty one. Pages are read whole.
    """
    fixed = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kinds = [fixed.schema[c].dataType.simpleString() for c in ("key", "url")]
    return fixed.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
