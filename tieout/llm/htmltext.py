"""Main text of web pages by composite text density.

Every element gets the characters and tags below it and those of them inside links; its density is
characters per tag, raised or lowered by how the link share compares with the page's. A parent's
score is the sum of its children's densities, and the subtree with the largest score is the
article. Where that subtree is the body itself, its children are kept that reach the smallest
density on the path from the densest element up to the body, and prose that is not mostly links.
Where it is smaller and no article or main element holds it, the elements beside it and beside those
around it are kept too that reach that density, or have a paragraph that does, counted in characters
per tag; a parent of several such sections also gives its prose.

Before scoring, elements go that are never article text: scripts, styles, forms, menus, footers,
sidebars, and blocks whose class, id or role says notice, advert, comments and the like.

Defined results: null or empty html, and pages without text, give the empty text; broken markup is
closed where HTML would close it; repeated rows give repeated rows; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

TOKEN = re.compile(
    r"""<!--(?:(?!-->).)*+(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|noframes|object)"""
    r"""(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^<>]*+>|</?[a-zA-Z][^<>]*+>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.@]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul caption legend option head title search".split())
DROPPED = frozenset(
    "head nav footer aside form button menu dialog input label legend fieldset script style noscript template iframe svg"
    " math textarea select noframes object canvas audio video map search".split())
# Opening the first closes an open one of the second, up to the stop.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
INLINE_STOP = frozenset("td th table button object caption li dd dt".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|adbox|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|sidebars?|side|aside|footer|foot|header|masthead|comments?|commentlist|replies|respond|disqus|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommend\w*|pagination|pager|toolbar|widget|copyright|disclaimer|hidden|"
    r"skip|toc|tags)(?=$|[\s_-])", re.I)
REMARK = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?=$|[\s_-])", re.I)
# Says what the rest of the page has, not what the element is.
LAYOUT = re.compile(r"\b(?:has|with|without|no)[_-][\w-]*", re.I)
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure table ul ol dl".split())
PARAGRAPHS = frozenset("p pre blockquote".split())
CONTAINERS = frozenset(("article", "main"))


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in MARKED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    pattern = REMARK if tag == "article" else MARKED
    return any(pattern.search(LAYOUT.sub(" ", found.get(name, ""))) for name in ("class", "id"))


class Page:
    """The kept nodes in page order: parallel lists, a parent always before its children."""

    def __init__(self, source: str):
        self.tags, self.parents, self.parts = ["#page"], [-1], []  # parts: (node, text)
        self._open, self._count = [0], Counter()  # open nodes, and how many of each tag
        self._read(source)

    def _add(self, tag: str) -> int:
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        return len(self.tags) - 1

    def _push(self, tag: str) -> None:
        self._open.append(self._add(tag))
        self._count[tag] += 1

    def _pop(self, wanted: frozenset | set, stop: frozenset | set) -> None:
        if not any(self._count[tag] for tag in wanted):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in wanted:
                self._count.subtract(self.tags[i] for i in self._open[depth:])
                del self._open[depth:]
                return
            if tag in stop:
                return

    def _read(self, source: str) -> None:
        at, muted, depth = 0, "", 0  # muted: the dropped element we are in, depth: how often it is open
        match = TOKEN.search(source)
        while match:
            if match.start() > at and not muted:
                self.parts.append((self._open[-1], source[at:match.start()]))
            at = match.end()
            tag = (match["tag"] or "").lower()
            if raw := match["raw"]:
                close = re.compile(rf"</{raw}\s*+[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif tag and muted:
                if tag == muted and tag not in VOID:
                    depth += -1 if match["end"] else 0 if match["attrs"].endswith("/") else 1
                    muted = muted if depth else ""
                elif match["end"] and tag in ("body", "html") or tag == "body" and muted == "head":
                    muted = ""
                    if not match["end"]:
                        self._push(tag)
            elif tag and match["end"]:
                self._pop({tag}, INLINE_STOP if tag not in BLOCK else frozenset())
            elif tag:
                if tag in BLOCK:
                    self._pop({"p"}, INLINE_STOP | {"div", "article", "section", "blockquote", "body"})
                if tag in CLOSES:
                    self._pop(*CLOSES[tag])
                if _unwanted(tag, match["attrs"], any(self._count[c] for c in CONTAINERS)):
                    if tag not in VOID:
                        muted, depth = tag, 1
                elif tag in VOID:
                    self._add(tag)
                    if tag in ("br", "hr", "img"):
                        self.parts.append((self._open[-1], "\n" if tag != "img" else ""))
                elif not match["attrs"].endswith("/") or tag in BLOCK:
                    self._push(tag)
            match = TOKEN.search(source, at)
        if at < len(source) and not muted:
            self.parts.append((self._open[-1], source[at:]))

    def subtree(self) -> set[int] | None:
        """The nodes whose subtrees hold the article; None for the whole page."""
        count = len(self.tags)
        chars, links, tags, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
        linked = [False] * count
        for i in range(1, count):
            linked[i] = self.tags[i] == "a" or linked[self.parents[i]]
        for node, text in self.parts:
            size = len(text) - text.count(" ") - text.count("\n")
            chars[node] += size
            if linked[node]:
                links[node] += size
        for i in range(count - 1, 0, -1):
            up = self.parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.tags[i] == "a")
        body = next((i for i in range(count) if self.tags[i] == "body"), 0)
        base = links[body] / max(chars[body], 1)
        density = [0.0] * count
        for i in range(count):
            c, lc, t, lt = chars[i], links[i], max(tags[i], 1), max(link_tags[i], 1)
            if c:
                floor = math.log(c / max(c - lc, 1) * lc + base * c + math.e)
                share = c / max(lc, 1) * t / lt
                density[i] = c / t * math.log(max(share, 1.0)) / math.log(max(floor, math.e)) if share > 1 else c / t * 1e-3
        score = [0.0] * count
        for i in range(1, count):
            score[self.parents[i]] += density[i]
        if not chars[body]:
            return None
        best = max(range(body, count), key=lambda i: (score[i], -i))
        if not score[best]:
            return {body}
        held = [i for i in self._path(best) if self.tags[i] in CONTAINERS]
        if held:
            return {held[-1]}
        while best != body and self.tags[best] not in BLOCK - {"p", "li", "td", "th", "tr", "dd", "dt", "tbody", "ul",
                                                               "ol", "dl", "blockquote", "pre", "figure"}:
            best = self.parents[best]  # a paragraph, list or table belongs to the block around it
        densest = max(range(body + 1, count), key=lambda i: density[i], default=body)
        path = [i for i in [*self._path(densest), body] if i >= body]
        threshold = min(density[i] for i in path)
        if best != body:
            # density grows with an element's size, so a short section is measured by its paragraphs' plain density
            plain, prose = min(chars[i] / max(tags[i], 1) for i in path), [False] * count
            for i in range(count - 1, 0, -1):
                own = self.tags[i] in PARAGRAPHS and 2 * links[i] < chars[i] and chars[i] / max(tags[i], 1) >= plain
                prose[i] = prose[i] or own
                prose[self.parents[i]] |= prose[i]
            return self._with_siblings(best, body, [
                2 * links[i] < chars[i] and (density[i] >= threshold or prose[i]) for i in range(count)],
                [self.tags[i] in PROSE and 2 * links[i] < chars[i] for i in range(count)])
        kept = {i for i in range(body + 1, count) if self.parents[i] == body
                and (density[i] >= threshold or self.tags[i] in PROSE and 2 * links[i] < chars[i])}
        return kept | {-body - 1}

    def _with_siblings(self, best: int, body: int, sections: list[bool], prose: list[bool]) -> set[int]:
        """The best node and, on its way up to the body, sections beside it; a parent of several also gives its prose."""
        children: dict[int, list[int]] = {}
        for i in range(body + 1, len(self.tags)):
            children.setdefault(self.parents[i], []).append(i)
        kept = {best}
        for node in self._path(best):
            if node <= body:
                break
            beside = [i for i in children[self.parents[node]] if i != node]
            if any(sections[i] for i in beside):
                kept |= {i for i in beside if sections[i] or prose[i]} | {-self.parents[node] - 1}
        return kept

    def _path(self, node: int) -> list[int]:
        path = []
        while node > 0:
            path.append(node)
            node = self.parents[node]
        return path

    def text(self) -> str:
        roots = self.subtree()
        if roots is None:
            return ""
        own = {-r - 1 for r in roots if r < 0}  # nodes of which only the direct text counts
        count = len(self.tags)
        within, block = [False] * count, [0] * count
        within[0] = 0 in roots
        for i in range(1, count):
            within[i] = i in roots or within[self.parents[i]]
            block[i] = i if self.tags[i] in BLOCK else block[self.parents[i]]
        blocks, held, last = [], [], -1
        for node, text in self.parts:
            if within[node] or node in own:
                if block[node] != last and held:
                    blocks.append("".join(held))
                    held = []
                last = block[node]
                held.append(text)
            elif held:
                blocks.append("".join(held))
                held = []
        blocks.append("".join(held))
        clean = (" ".join(entities.unescape(b).split()) for b in blocks)
        return " ".join(b for b in clean if b)


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, text, n_chars) of every page."""
    def start() -> Callable:
        def work(sources: list[str]) -> list:
            texts = [main_text(s) for s in sources]
            return [texts, np.fromiter(map(len, texts), "i8", len(texts))]
        return work
    return map_texts(pages, keys, html, "text string, n_chars bigint", start)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"], "html")
