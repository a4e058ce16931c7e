"""Main text of HTML by composite text density (Sun, Song and Liao 2011).

A page becomes a tree, closing what HTML closes implicitly. Elements that are never article text (scripts,
menus, forms, notices, adverts, comments, ...) leave it by tag, role or class, unless they hold all articles of the page.
A name in a class or id isn't enough where the subtree has more than half of the text outside links of its article, or
of the page; readers' replies stay only on pages without other text.
For every other node: C characters, T tags, LC characters in links, LT link tags, all of its subtree. Its density is

    C / T * log(C * T / (LC * LT)) / log(1 + log(C * LC / (C - LC) + C * LCb / Cb + e))

with LCb, Cb those of body, and zeros counting as one. A node's density sum is the sum of its children's densities.
The threshold is the least density on the path from the node of the largest sum up to body; below body, nodes
at or above the threshold give their subtree of largest sum. Where that lies inside an article or main element,
the whole element is taken, so that short paragraphs and headings stay.

Blocks are the text between block boundaries, in page order; white space inside a block becomes one space.

Defined results: null and empty pages, and pages without text, give the empty text; a page that breaks off
is closed where it ends, and a tag that breaks off is no text; rows that repeat each give their text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr li dd dt".split()) | frozenset("li dd dt".split())
#: What a start tag closes, and where looking for it stops.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
NEVER = frozenset("head nav aside footer form script style noscript iframe svg math button select textarea template object dialog menu title canvas audio video input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments commentlist respond replies reply disqus sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup share sharing social related recommended popup modal overlay toolbar pagination pager masthead login search".split())
OUTSIDE = frozenset("header topbar".split())
#: Sections that readers write: with names of these alone, they go however long they are, unless they are all there is.
REPLIES = frozenset("comment comments commentlist respond replies reply disqus".split())
#: Words that turn a name after or before them into a remark on the layout ("no-sidebar", "share-enabled").
BEFORE = frozenset("no not has have with without".split())
AFTER = frozenset("enabled disabled layout ready".split())
ROOMY = frozenset("html body article main".split())

#: A quote delimits only after "="; one that never closes is an ordinary character, and its tag ends at the next ">".
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z)|<[!?/][^>]*+>?|[^<]++|<""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _names(value: str) -> tuple[set[str], bool]:
    """The words of a class or id that name a thing, and whether a token consists of words for readers' replies alone."""
    found, replies = set(), False
    for token in value.split():
        words = _WORDS.findall(token)
        found.update(w for k, w in enumerate(words) if not (k and words[k - 1] in BEFORE or k + 1 < len(words) and words[k + 1] in AFTER))
        replies = replies or bool(words) and REPLIES.issuperset(words)
    return found, replies


class Page:
    """The tree in arrays: nodes in page order, a parent before its children; events are texts and block boundaries (None)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs, self.begin, self.end = ["#root"], [-1], [""], [0], [0]
        self.events: list[str | None] = []
        self.owner: list[int] = []
        self._parse(html)

    def _put(self, node: int, text: str | None) -> None:
        self.events.append(text)
        self.owner.append(node)

    def _parse(self, html: str) -> None:
        stack, at, size = [0], 0, len(html)
        tags = self.tag

        def close(to: int) -> None:
            while len(stack) > to:
                node = stack.pop()
                self.end[node] = len(self.events)
                if tags[node] in BLOCK:
                    self._put(stack[-1], None)

        while at < size:
            m = _TOKEN.match(html, at)
            at = m.end()
            name = m[2]
            if name is None:
                piece = m[0]
                if piece[0] != "<" or len(piece) == 1:
                    self._put(stack[-1], unescape(piece) if "&" in piece else piece)
                continue
            if m[4] != ">":
                break
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        close(k)
                        break
                    if tags[stack[k]] in ("article", "main", "table", "body") and name in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                        break
                continue
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in BLOCK or tags[stack[k]] in ("button", "object"):
                        break
            if name in SAME:
                closes, stops = SAME[name]
                low = None
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in stops:
                        break
                    if tags[stack[k]] in closes:
                        low = k
                if low is not None:
                    close(low)
            if name == "body" and "head" in (tags[k] for k in stack):
                close(next(k for k, n in enumerate(stack) if tags[n] == "head"))
            if name in BLOCK:
                self._put(stack[-1], None)
            node = len(tags)
            tags.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(m[3])
            self.begin.append(len(self.events))
            self.end.append(len(self.events))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
                if name == "br" or name in BLOCK:
                    self._put(stack[-1], " " if name == "br" else None)
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else size
                self.end[node] = len(self.events)
                continue
            stack.append(node)
        close(1)
        self.end[0] = len(self.events)

    def gone(self) -> list[bool]:
        """Whether a node is in a part that is never article text."""
        n = len(self.tag)
        holds, inside, frame = [int(t in ("article", "main")) for t in self.tag], [False] * n, [0] * n
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] += holds[i]
        kind, off = [""] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            framed = self.tag[up] in ("article", "main")
            inside[i], frame[i] = inside[up] or framed, up if framed else frame[up]
            kind[i] = self._boiler(i, inside[i])
            # what holds every article of the page is a frame around it, whatever its name says
            if holds[i] and holds[i] == holds[0]:
                kind[i] = ""
            off[i] = off[up] or kind[i] == "sure" or self.tag[i] == "a"
        replies = self._amounts(off)
        for i in range(1, n):
            # readers' replies are no bulk, unless the page has nothing else
            off[i] = off[i] or off[self.parent[i]] or kind[i] == "replies" and replies[i] < replies[0]
        plain = self._amounts(off)
        # beside an article that nothing names, what is named is no main text, however long
        clear = [True] * n
        for i in range(1, n):
            clear[i] = clear[self.parent[i]] and not kind[i]
        elsewhere = any(clear[i] and plain[i] and self.tag[i] in ("article", "main") for i in range(1, n))
        out = [False] * n
        for i in range(1, n):
            named = kind[i] == "name" and (2 * plain[i] <= plain[frame[i]] or elsewhere and not inside[i]) or kind[i] == "replies" and (off[i] or not plain[i])
            out[i] = out[self.parent[i]] or kind[i] == "sure" or named
        return out

    def _amounts(self, off: list[bool]) -> list[int]:
        """Characters of each subtree, without the nodes that are off."""
        c = [0] * len(self.tag)
        for text, node in zip(self.events, self.owner, strict=True):
            if text and not off[node]:
                c[node] += len(text.strip())
        for i in range(len(c) - 1, 0, -1):
            c[self.parent[i]] += c[i]
        return c

    def _boiler(self, i: int, inside: bool) -> str:
        """Whether a node is boilerplate for sure, by its name (unless it has the bulk of the text), as replies, or not."""
        tag = self.tag[i]
        if tag in NEVER or tag == "header" and not inside:
            return "sure"
        if tag in ROOMY or not self.attrs[i]:
            return ""
        out = ""
        for m in _ATTR.finditer(self.attrs[i]):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" and "=" not in m[0] or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "sure"
            if key == "role" and value in ROLES:
                return "sure"
            if key in ("class", "id"):
                words, replies = _names(value)
                if replies:
                    out = "replies"
                elif not out and (not NAMES.isdisjoint(words) or not inside and not OUTSIDE.isdisjoint(words)):
                    out = "name"
        return out

    def densities(self, gone: list[bool]) -> tuple[list[float], list[float]]:
        """(density, density sum) by node; parts that are gone count nowhere."""
        n = len(self.tag)
        c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
        for text, node in zip(self.events, self.owner, strict=True):
            if text and not gone[node]:
                c[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            link = self.tag[i] == "a"
            if link:
                lc[i] = c[i]
            up = self.parent[i]
            c[up] += c[i]
            t[up] += t[i] + 1
            lc[up] += lc[i]
            lt[up] += lt[i] + link
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        rate = lc[body] / max(c[body], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if c[i] and not gone[i]:
                base = math.log(c[i] * lc[i] / max(c[i] - lc[i], 1) + rate * c[i] + math.e)
                tags = max(t[i], 1)
                ratio = c[i] * tags / (max(lc[i], 1) * max(lt[i], 1))
                density[i] = c[i] / tags * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0) + 1)
            if i:
                total[self.parent[i]] += density[i]
        return density, total

    def main_node(self, gone: list[bool]) -> int:
        density, total = self.densities(gone)
        n = len(self.tag)
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        live = [i for i in range(body, n) if not gone[i]]
        if not live:
            return body
        best = max(live, key=lambda i: (total[i], density[i], -i))
        threshold, at = density[best], best
        while at > body:
            threshold, at = min(threshold, density[at]), self.parent[at]
        # subtrees whose root reaches the threshold, and in them the largest sum
        reach = [False] * n
        for i in live:
            reach[i] = density[i] >= threshold or i > 0 and reach[self.parent[i]]
        found = [i for i in live if reach[i]] or [best]
        best = at = max(found, key=lambda i: (total[i], density[i], -i))
        while at > 0:
            if self.tag[at] in ("article", "main"):
                best = at
                if self.tag[at] == "article":
                    break
            at = self.parent[at]
        return best

    def text(self) -> str:
        gone = self.gone()
        node = self.main_node(gone)
        blocks, now = [], []
        for k in range(self.begin[node], self.end[node]):
            piece = self.events[k]
            if piece is None:
                blocks.append("".join(now))
                now = []
            elif not gone[self.owner[k]]:
                now.append(piece)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); a page at a time, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
