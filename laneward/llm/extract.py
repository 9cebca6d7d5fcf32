"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead "
    "tr ul xmp".split()
)
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: An element started inside these does not close what is open outside of them.
SCOPE = frozenset("table ul ol dl div section article body html td th blockquote svg object template".split())
DROPPED = frozenset("nav footer aside form menu dialog button select search head svg template".split())
FOREIGN = frozenset({"svg", "math"})
#: Elements of svg and math that hold HTML; outside of them these HTML start tags end an open svg or math.
HOLDS_HTML = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
LEAVES = frozenset(
    "article aside b big blockquote body br center code dd div dl dt em embed figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strong strike sub sup table "
    "tt u ul var".split()
)
#: What may stand in head; anything else, and any text, ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
LANDMARK = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id or role that mark menus, notices, adverts and reader comments. A token is a
#: hint if it is one of them or is made of them and words of PLACES before or PARTS after them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pagination "
    "paywall popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar usercomment usercomments widget".split()
)
PLACES = frozenset("bottom desktop footer global left main mobile primary right secondary site sticky sub top".split())
PARTS = frozenset("area bar block box button buttons container danger form info inner item items links list panel slot success unit warning wrap wrapper".split())
COMPOUNDS = frozenset(
    "article-comments comment-author comment-body comment-content comment-meta comment-text comments-section "
    "entry-comments post-comments post-navigation posts-navigation reader-comments related-articles related-content "
    "related-news related-posts related-stories user-comments widget-title".split()
)
#: What belongs to an article also where it stands beside it.
BESIDE = frozenset("h1 h2 hgroup p".split())
TITLES = frozenset("header masthead".split())
READERS = frozenset("comment comments disqus replies respond usercomment usercomments".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_MAY_HIDE = re.compile("hidden|display", re.I)
_CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def _hints(attributes: str) -> frozenset[str]:
    """The words of HINTS that mark an element, by its class, id and role."""
    found: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for token in unescape(value.strip("\"'")).lower().split():
                parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
                words = [k for k, p in enumerate(parts) if p in HINTS]
                if words and (
                    "-".join(parts) in COMPOUNDS
                    or all(p in PLACES for p in parts[: words[0]])
                    and all(p in HINTS or p in PARTS for p in parts[words[0] :])
                ):
                    found.update(parts[k] for k in words)
    return frozenset(found)


def _hidden(attributes: str) -> bool:
    """Whether browsers do not show an element, by its own attributes."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or key == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value.strip("\"'").lower()):
            return True
    return False


class Page:
    """A page's elements in document order, with what density needs of each.

    text holds (element, block, characters); blocks are numbered in page order.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.drop = ["#root"], [0], [False]
        self.hints: dict[int, frozenset[str]] = {}
        self.lesser: set[int] = set()  # articles that are comments, adverts or teasers themselves
        self.text: list[tuple[int, int, str]] = []
        self.block = 0
        self.open = [0]
        self.held: Counter[str] = Counter()  # open elements by name
        self.inside, self.in_foreign = [False], [False]  # a landmark; svg or math, the element itself included
        self.foreign = False  # whether an svg or math was met
        self._parse(html)
        self._drop_hinted()

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._chars(html[at:])
                return
            if lt > at:
                self._chars(html[at:lt])
            follow = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif follow in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif follow == "/" or follow.isalpha():
                found = _TAG.match(html, lt) or _LOOSE.match(html, lt)
                if found is None:
                    if follow == "/" and not html[lt + 2 : lt + 3].isalpha():
                        end = html.find(">", lt)
                        at = n if end < 0 else end + 1
                    elif follow.isascii():
                        return  # a tag that the page's end cuts off
                    else:
                        self._chars("<")
                        at = lt + 1
                    continue
                at = found.end()
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                elif name in RAW:
                    if found[3].rstrip().endswith("/") and self._in_foreign():
                        continue
                    close = _CLOSE_RAW[name].search(html, at)
                    if name == "xmp":
                        self._start(name, found[3].rstrip("/ \t\n\r\f"))
                        self._chars(html[at : close.start() if close else n].replace("&", "&amp;"))
                        self._end(name)
                    at = n if close is None else close.end()
                else:
                    self._start(name, found[3])
            else:
                self._chars("<")
                at = lt + 1

    def _in_foreign(self) -> bool:
        return self.in_foreign[self.open[-1]]

    def _cut(self, depth: int) -> None:
        self.held.subtract(self.tag[i] for i in self.open[depth:])
        del self.open[depth:]

    def _leave_foreign(self) -> None:
        depth, top = len(self.open), len(self.open)
        while depth > 1 and self.tag[self.open[depth - 1]] not in HOLDS_HTML:
            depth -= 1
            if self.tag[self.open[depth]] in FOREIGN:
                top = depth
        self._cut(top)

    def _leave_head(self) -> None:
        if self.tag[self.open[-1]] == "head":
            self._cut(len(self.open) - 1)

    def _chars(self, raw: str) -> None:
        if self.tag[self.open[-1]] == "head" and not raw.isspace():
            self._leave_head()
        self.text.append((self.open[-1], self.block, raw))

    def _start(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD:
            self._leave_head()
        if self.foreign and name in LEAVES:
            self._leave_foreign()
        self.foreign = self.foreign or name in FOREIGN
        if name == "br":
            self._chars(" ")
        if name in ("td", "th"):
            self._chars(" ")
        if name in BLOCK:
            self.block += 1
            self._close({"p"})
        if name in CLOSES:
            self._close(CLOSES[name])
        if name in VOID:
            return
        parent = self.open[-1]
        drop = self.drop[parent]
        if not drop and name not in ("html", "body", *LANDMARK):
            inside = self.inside[parent]
            drop = name in DROPPED or name == "header" and not inside
            hints = _hints(attributes) if attributes and not drop and name not in HEADINGS else frozenset()
            if inside:
                hints = frozenset() if name == "header" else hints - TITLES
            if hints:
                self.hints[len(self.tag)] = hints
        elif name == "article" and attributes and _hints(attributes):
            self.lesser.add(len(self.tag))
        drop = drop or bool(attributes) and _MAY_HIDE.search(attributes) is not None and _hidden(attributes)
        self.tag.append(name)
        self.parent.append(parent)
        self.drop.append(drop)
        self.inside.append(self.inside[parent] or name in LANDMARK)
        self.in_foreign.append(self.in_foreign[parent] or name in FOREIGN)
        if not attributes.rstrip().endswith("/"):
            self.open.append(len(self.tag) - 1)
            self.held[name] += 1

    def _close(self, names: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of these names, and what it holds, within its scope."""
        if not any(self.held[name] for name in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                self._cut(depth)
                return
            if tag in SCOPE:
                return

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if not self.held[name]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == name:
                self._cut(depth)
                return

    def _drop_hinted(self) -> None:
        """Drop what hints mark, and all it holds, but no element that holds a landmark of the article.

        An element that holds a landmark is doubtful. It stays if it holds main. If it marks
        reader comments, it stays only if it holds one article, most of the text, and no
        landmark has text outside of it. Else it stays if no landmark has text outside of it
        or at most half of its text is links. Articles with hints of their own do not count.
        """
        if not self.hints:
            return
        n = len(self.tag)
        last, chars, links, linked = list(range(1, n + 1)), [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for i, _, raw in self.text:
            if not self.drop[i]:
                size = len(" ".join(raw.split()))
                chars[i] += size
                links[i] += size * linked[i]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            last[p] = max(last[p], last[i])
            chars[p] += chars[i]
            links[p] += links[i]
        marks = [i for i in range(n) if self.tag[i] in LANDMARK and not self.drop[i] and i not in self.lesser]
        for i, hints in self.hints.items():
            if self.drop[i]:
                continue
            held = marks[bisect_right(marks, i) : bisect_left(marks, last[i])]
            if held:
                if any(self.tag[m] == "main" for m in held):
                    continue
                alone = not any(
                    not self.drop[m] and chars[m] > chars[i] * (m < i < last[m]) for m in marks if not i < m < last[i]
                )
                if hints & READERS:
                    if alone and len(held) == 1 and 2 * chars[i] > chars[0]:
                        continue
                elif alone or 2 * links[i] <= chars[i]:
                    continue
            self.drop[i : last[i]] = [True] * (last[i] - i)

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """For each element: composite density, sum over its children, characters, those in links. Dropped ones count nothing."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked, formula = [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
            formula[i] = formula[self.parent[i]] or self.tag[self.parent[i]] == "math"
        for i, _, raw in self.text:
            if not self.drop[i]:
                size = len(" ".join(raw.split()))
                chars[i] += size
                if linked[i]:
                    link_chars[i] += size
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + (not formula[i])  # a formula is one tag, however it is marked up
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = link_chars[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.drop[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
                base = log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + e)
                density[i] = c / t * log(max(c / lc * t / lt, 1.0)) / log(max(base, 1.001))
            if i:
                total[self.parent[i]] += density[i]
        return density, total, chars, link_chars


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, parted by one line feed.

    Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles
    and reader comments are left out by element name and by class, id and role;
    a class, id or role never drops what holds the article, nor a heading. Drawings
    (svg), templates, hidden elements and what browsers show only without scripts or frames go too;
    formulas, the inside of object and listings stay.
    Of what is left the subtree with the largest sum of densities is sought. If a
    landmark (article, main) holds it or is held by it, the whole landmark is main
    text, and so are other landmarks whose density reaches the least density on its
    path to the body, and headings and paragraphs beside them in the element that
    holds them. Without a landmark it is every element on or beside the path from it to the body whose
    density reaches the least density on that path, so that a paragraph beside
    the best subtree stays.
    """
    if not html:
        return ""
    page = Page(html)
    density, total, chars, links = page.densities()
    n = len(page.tag)
    last = list(range(1, n + 1))  # end of each subtree in document order
    for i in range(n - 1, 0, -1):
        last[page.parent[i]] = max(last[page.parent[i]], last[i])
    best = max(range(n), key=lambda i: (total[i], density[i], -i))

    def path_of(at: int) -> list[int]:
        path = [at]
        while at and page.tag[at] != "body":
            at = page.parent[at]
            path.append(at)
        return path

    marks = [i for i in range(n) if page.tag[i] in LANDMARK and not page.drop[i] and chars[i]]
    near = [i for i in marks if i <= best < last[i]]
    near = near or [i for i in marks if best <= i < last[best]]
    if near:
        top = max(near, key=lambda i: (total[i] + density[i], -i))
        path = path_of(top)
        threshold = min(density[i] for i in path)
        taken = {top} | {i for i in marks if i not in page.lesser and density[i] >= threshold and not i <= top < last[i]}
        # headings and paragraphs that stand beside an article in the element that holds it
        beside = {page.parent[i] for i in taken if page.tag[page.parent[i]] not in ("#root", "html", "body")}
        taken |= {
            i for i in range(n)
            if page.parent[i] in beside and page.tag[i] in BESIDE and not page.drop[i] and 2 * links[i] <= chars[i] and chars[i]
        }
        kept, end = [], 0
        for i in sorted(taken):
            if i >= end:
                kept.append((i, last[i]))
                end = last[i]
    else:
        path = path_of(best)
        threshold = min(density[i] for i in path)
        kept, at = [], 0
        on_path = set(path)
        while at < n:
            if at not in on_path and density[at] >= threshold > 0 or at == best:
                kept.append((at, last[at]))
                at = last[at]
            else:
                at += 1
        if not kept:
            kept = [(0, n)]
    shown = [False] * n
    for a, b in kept:
        shown[a:b] = [True] * (b - a)
    blocks: dict[int, list[str]] = {}
    for i, block, raw in page.text:
        if shown[i] and not page.drop[i]:
            blocks.setdefault(block, []).append(unescape(raw) if "&" in raw else raw)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Each page is taken whole, in one task, without a shuffle. Null and empty html
    give an empty text, as does a page without any. Markup that is broken or cut
    off is read as far as it goes. Repeated rows are extracted each; null ids and
    urls stay. Columns other than page_id, url and html are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
