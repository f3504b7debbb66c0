"""Main text of web pages by line-block distribution.

Markup is stripped, and what is left forms lines, one for each block. The lengths of
the lines' text outside links are summed over sliding windows of lines; the regions
between a surge point, where the sum rises over a threshold, and a dive point, where
it falls to nothing, hold the main text. The element around the regions gives its
edges, so that titles, short paragraphs and lists beside long ones stay:

- A region ends where its element does. Regions of a tenth or more of the largest one's text count, and those beside one
  in the same element, article or main. The main text's element is the innermost
  around all of them; if each lies in an article or main, these are.
- All lines of that element belong to the text, but for parts that hold links alone
  and lie before the first or behind the last region. If the element is the page's
  body, lines outside the regions belong to it only if they stand in an element of a
  region's own lines. A heading right before the text belongs to it.
- A page without any region gives the lines of the element that holds most text.

Elements that by name, role or class are no article text (menus, headers, footers,
sidebars, notices, adverts, forms, comments) are left out of all this. A class counts
if one of its names is such a word, or begins or ends with one; the latter is no more
than a hint, and is passed over if the page has no region without such elements.

Defined results: a null or empty html gives an empty text; broken or unclosed
markup is read as far as it goes, in time that grows with its length; elements over
DEEPEST deep count for the last one that isn't; repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

#: Lines of a window, and the characters in it that make a surge, as the
#: method was published.
WINDOW, SURGE = 3, 86
#: Share of the largest region's text that makes another region count by itself.
COUNTS = 0.1
#: Names of elements and words in class, id and role attributes.
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "svg", "canvas", "object", "select"})
NEVER_TEXT = frozenset({"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"})
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NESTING = frozenset("article aside body button center details dialog div dl fieldset figure footer form head header main menu nav ol section table ul blockquote".split())
CONTENT = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2"})
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist respond replies disqus cookie cookies consent gdpr notice notices notification alert menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended newsletter subscribe popup modal toolbar login signup pagination pager".split()
)
#: Words that make a class no hint beside one of the above, as in has-sidebar or post-header.
NO_HINTS = frozenset("has no with without post entry article content story main text body".split())
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"})

#: What a tag begins with; what ends it, or hides its end.
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""[>"']""")
#: Elements within one another that are told apart; what lies deeper counts for the last of them.
DEEPEST = 512
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Line(NamedTuple):
    """A block's text, the characters of it in links, its innermost element, and whether it is a heading."""

    text: str
    linked: int
    element: int
    heading: bool


class Element(NamedTuple):
    """An element's name, the number of the one around it, and the outermost element around both that is hinted at (0: none)."""

    name: str
    parent: int
    hinted: int


def _matter(name: str, attributes: str, inside: list[str]) -> int:
    """2 if an element holds no article text, 1 if a class hints at that, else 0."""
    if name in CONTENT or name in ("body", "html"):
        return 0
    if name in NEVER_TEXT:
        return 0 if name == "header" and not CONTENT.isdisjoint(inside) else 2
    found = 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split():
            words = _WORD.findall(token)
            if kind.lower() == "role":
                found = max(found, 2 * (token in ROLES))
            elif words and not (words[0] not in HINTS and words[-1] not in HINTS) and NO_HINTS.isdisjoint(words):
                found = max(found, 2 if len(words) == 1 else 1)
    return found


class Tags:
    """The tags of a page, by one scan that never goes back: a page that is broken takes no longer than another.

    A tag ends at the first > outside quotes, else at the first >. Where a chain of
    quotes leads is noted for each quote in it, so none is followed twice.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.known: dict[int, int] = {}

    def _end(self, at: int) -> int:
        passed, end = [], -1
        while (m := _STOP.search(self.page, at)) is not None:
            q = m.start()
            if m[0] == ">" or q in self.known:
                end = self.known.get(q, q)
                break
            passed.append(q)
            if q >= self.last[m[0]]:
                break
            at = self.page.index(m[0], q + 1) + 1
        self.known.update(dict.fromkeys(passed, end))
        return end

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Where the next tag begins and ends, whether it closes, its name and attributes (no name: a comment or the like)."""
        while (start := self.page.find("<", at)) >= 0:
            if self.page.startswith("<!--", start):
                end = self.page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(self.page), "", "", ""
            if start > self.last[">"]:
                return None
            if self.page[start + 1 : start + 2] in ("!", "?"):
                return start, self.page.index(">", start) + 1, "", "", ""
            if m := _NAME.match(self.page, start + 1):
                end = self._end(m.end())
                end = end if end >= 0 else self.page.index(">", start)
                return start, end + 1, m[1], m[2].lower(), self.page[m.end() : end]
            at = start + 1
        return None

    def after(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup, or the page's end."""
        m = re.compile(rf"</{name}\b", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m and m.end() <= self.last[">"] else -1
        return end + 1 if end >= 0 else len(self.page)


def lines(page: str) -> tuple[list[Line], list[Element]]:
    """The lines of a page that may be text, and its elements; the page itself is element 0."""
    out: list[Line] = []
    elements = [Element("", 0, 0)]
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    deeper: Counter[str] = Counter()
    buffer: list[str] = []
    linked: list[str] = []
    tags, at, n = Tags(page), 0, len(page)
    skipping = inside = links = 0
    heading = False

    def end_line() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            out.append(Line(text, len(" ".join(html.unescape("".join(linked)).split())), inside, heading))
        buffer.clear()
        linked.clear()

    while at < n:
        tag = tags.next(at)
        if not skipping:
            buffer.append(page[at : tag[0] if tag else n])
            if links:
                linked.append(buffer[-1])
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                at = tags.after(name, at)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCKS:
            end_line()
            heading = name in HEADINGS and not closing
        if name not in NESTING:
            continue
        if not closing and len(stack) >= DEEPEST:
            deeper[name] += 1
        elif not closing:
            matter = _matter(name, attributes, [x for x in CONTENT if opened[x]])
            stack.append((name, matter == 2, inside))
            opened[name] += 1
            skipping += matter == 2
            hinted = elements[inside].hinted or (len(elements) if matter == 1 else 0)
            elements.append(Element(name, inside, hinted))
            inside = len(elements) - 1
        elif deeper[name]:
            deeper[name] -= 1
        elif opened[name]:
            while True:
                last, never, before = stack.pop()
                opened[last] -= 1
                skipping -= never
                inside = before
                if last == name:
                    break
    end_line()
    return out, elements


def regions(lengths: list[int]) -> list[tuple[int, int]]:
    """First and last line, exclusive, of every region from a surge to its dive."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    found, start = [], None
    for i in range(n + 1):
        if start is None and i < n and sums[i] >= SURGE and lengths[i] >= SURGE // WINDOW:
            start = i
        elif start is not None and (i == n or sums[i] < SURGE and lengths[i] < SURGE // WINDOW):
            found.append((start, i))
            start = None
    return found


def _around(element: int, elements: list[Element]) -> list[int]:
    """The element and all around it, the page last."""
    out = [element]
    while out[-1]:
        out.append(elements[out[-1]].parent)
    return out


def _common(held: set[int], elements: list[Element]) -> int:
    """The innermost element around all of these."""
    # Elements are numbered as they open: the last of several holds none of the others.
    held = set(held)
    while len(held) > 1:
        last = max(held)
        held.remove(last)
        held.add(elements[last].parent)
    return held.pop()


def _same(elements: list[int], start: int) -> list[tuple[int, int]]:
    """First and last, exclusive, of each run of equal elements, counted from ``start``."""
    cuts = [0, *(i for i in range(1, len(elements)) if elements[i] != elements[i - 1]), len(elements)]
    return [(start + a, start + b) for a, b in zip(cuts, cuts[1:], strict=False)]


def choose(found: list[Line], elements: list[Element]) -> list[int]:
    """The numbers of the lines that are main text."""
    lengths = [len(x.text) - x.linked for x in found]
    kept = regions(lengths)
    if not kept:
        held: dict[int, int] = {}
        for x, size in zip(found, lengths, strict=True):
            held[x.element] = held.get(x.element, 0) + size
        most = max(held, key=lambda e: (held[e], -e), default=None)
        return [i for i, x in enumerate(found) if x.element == most and held[most]]
    # What follows on one another in different elements are regions of their own.
    kept = [(a, b) for start, stop in kept for a, b in _same([x.element for x in found[start:stop]], start)]
    size = [sum(lengths[a:b]) for a, b in kept]
    main = max(range(len(kept)), key=size.__getitem__)
    homes = [found[a].element for a, _ in kept]

    def beside(r: int) -> bool:
        own, other = _around(homes[r], elements), _around(homes[main], elements)
        near = set(own[:2]) & set(other[:2])
        return any(elements[e].name not in ("", "html", "body") for e in near) or any(elements[e].name in CONTENT for e in set(own) & set(other))

    counted = [r for r in range(len(kept)) if size[r] >= COUNTS * size[main] or beside(r)]
    first, last = kept[counted[0]][0], kept[counted[-1]][1]
    articles = {next((e for e in reversed(_around(homes[r], elements)) if elements[e].name in CONTENT), 0) for r in counted}
    inside = {_common({homes[r] for r in counted}, elements)} if 0 in articles else articles
    loose = 0 in articles and elements[min(inside)].name in ("", "html", "body")
    for e in range(min(inside) + 1, len(elements)):
        if elements[e].parent in inside:
            inside.add(e)
    own = {x.element for r in counted for x in found[slice(*kept[r])]}
    # Whether an element holds links alone, with all elements in it.
    text = dict.fromkeys(inside, 0)
    for x, n in zip(found, lengths, strict=True):
        for e in _around(x.element, elements) if x.element in inside else ():
            if e in text:
                text[e] += n
    out = [i for i, x in enumerate(found) if x.element in inside and (first <= i < last or (x.element in own if loose else x.element in own or text[x.element]))]
    for i in range(out[0] - 1, max(out[0] - 3, -1), -1) if out else ():
        if found[i].heading and not loose and not any(found[k].heading for k in out[:1]):
            return [*range(i, out[0]), *out]
    return out


def main_text(page: str | None) -> str:
    """The main text, its blocks in page order joined by line feeds."""
    found, elements = lines(page or "")
    # A hint doesn't count for what has a region of its own within an article.
    held: dict[int, list[int]] = {}
    for x in found:
        if h := elements[x.element].hinted:
            held.setdefault(h, []).append(len(x.text) - x.linked)
    text = {h for h, sizes in held.items() if regions(sizes) and any(elements[e].name in CONTENT for e in _around(h, elements))}
    plain = [x for x in found if not (h := elements[x.element].hinted) or h in text]
    if not regions([len(x.text) - x.linked for x in plain]) and regions([len(x.text) - x.linked for x in found]):
        plain = found
    return "\n".join(plain[i].text for i in choose(plain, elements))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, pages in pieces(batch, "html"):
            texts = [main_text(p) for p in pages]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return df.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
