"""Main text of web pages by composite text density.

A page becomes a flat tree: nodes in document order, each with its parent. Elements that are never article text
(scripts, forms, menus, page furniture, what a label calls an advert or a comment) are marked and count for
nothing. Every other node gets its composite density: characters per tag, lessened by the share of
its text that is links. A node's density sum adds up its children; the node of the largest sum, and the smallest
density on its path up to the body, decide which nodes are content. Their common container is the article,
widened to an `article` or `main` element around it, and its text comes out block by block.

Defined results: a null or empty page has an empty text; broken markup is read as far as it goes (an unfinished
tag at the end is markup, unclosed elements end with their parent); equal rows get equal texts; of equal sums the
first node wins; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows

# Element names of the public markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "script style noscript template svg math iframe object embed canvas audio video map select option datalist "
    "button input textarea label form fieldset nav aside footer menu dialog head title search".split()
)
CONTAINERS = frozenset("article main body section div td center blockquote html".split())
# A start tag of the key ends an open element of the value, up to an element of LIMITS.
ENDS = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
        "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), ("p",)
    ),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
    "body": ("head",),
}
LIMITS = frozenset("html body table ul ol dl td th article section main aside button object".split())
HEAD = frozenset("title meta link script style base noscript template".split())

# Elements whose labels say nothing about the article.
PLAIN = frozenset("main h1 p a b i em strong code br".split())
# Words in class, id and role that label what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification notifications modal popup overlay newsletter subscribe "
    "subscription signup paywall sidebar sidebars rail widget widgets menu menus navbar nav navigation breadcrumb "
    "breadcrumbs pagination pager toolbar share sharing social related recommended recommendations comment comments "
    "commentlist disqus reply replies respond discussion footer header masthead login search searchform skip "
    "copyright contentinfo complementary dialog alertdialog alert menubar form".split()
)
UNSAID = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "js-")

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
LABEL = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Nodes in document order: parent, name, whether marked as noise; and in reading order the texts of nodes,
    with None where a block begins or ends."""

    def __init__(self, html: str):
        self.parent = [-1]
        self.name = [""]
        self.noise = [False]
        self.texts: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._names = [""]
        self._open: Counter[str] = Counter()
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            open_at = html.find("<", at)
            if open_at < 0:
                self._text(html[at:])
                return
            if open_at > at:
                self._text(html[at:open_at])
            tag = TAG.match(html, open_at)
            if tag is None:
                at = self._odd(html, open_at)
                continue
            at = tag.end()
            name = tag[2].lower()
            if tag[1]:
                if self._open[name]:
                    self._close(len(self._names) - 1 - self._names[::-1].index(name))
                continue
            self._end_others(name)
            node = self._add(name, tag[3])
            if name in RAW:
                end = RAW_END[name].search(html, at)
                closing = html.find(">", end.start()) if end else -1
                at = n if closing < 0 else closing + 1
            elif name not in VOID:
                self._stack.append(node)
                self._names.append(name)
                self._open[name] += 1

    def _odd(self, html: str, at: int) -> int:
        """A comment, a declaration, markup that is not closed as it should be, or a plain sign; where it ends."""
        follows = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end, size = html.find("-->", at + 4), 3
        elif follows in ("", "!", "?", "/") or (follows.isascii() and follows.isalpha()):
            end, size = html.find(">", at), 1
        else:
            self._text("<")
            return at + 1
        return len(html) if end < 0 else end + size

    def _end_others(self, name: str) -> None:
        """Closes the open elements that a start tag ends."""
        names = self._names
        if self._open["head"] and name not in HEAD:
            self._close(names.index("head"))
        ended = ENDS.get(name)
        cut = None
        if ended and any(self._open[e] for e in ended):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ended:
                    cut = k
                elif names[k] in LIMITS:
                    break
        if cut:
            self._close(cut)

    def _close(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._open[self.name[node]] -= 1
            if self.name[node] in BLOCK:
                self.texts.append((node, None))
        del self._stack[depth:], self._names[depth:]

    def _add(self, name: str, attributes: str) -> int:
        node = len(self.name)
        self.parent.append(self._stack[-1])
        self.name.append(name)
        self.noise.append(name in SKIPPED or bool(attributes) and _labelled(name, attributes))
        if name in BLOCK:
            self.texts.append((node, None))
        elif name == "br":
            self.texts.append((self._stack[-1], " "))
        return node

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], unescape(text) if "&" in text else text))


def _labelled(name: str, attributes: str) -> bool:
    """Whether attributes hide an element, or call it something that is not the article."""
    if name in ("html", "body"):
        return False
    if name not in PLAIN:
        for label, *values in LABEL.findall(attributes):
            if label.lower() in ("class", "id", "role"):
                for token in "".join(values).split():
                    if not token.lower().startswith(UNSAID) and any(w.lower() in NOISE for w in WORDS.findall(token)):
                        return True
    low = attributes.lower()
    return ("hidden" in low or "display" in low) and _hidden(attributes)


def _hidden(attributes: str) -> bool:
    for label, *values in LABEL.findall(attributes):
        label, value = label.lower(), "".join(values).lower().replace(" ", "")
        if label == "hidden" or label == "aria-hidden" and value == "true":
            return True
        if label == "style" and "display:none" in value:
            return True
    return False


def _settle(page: Page) -> None:
    """Hands noise down to what is inside it. A label is not believed where a main element, or an article that is
    not itself labelled, stands inside."""
    n = len(page.name)
    holds = [False] * n
    in_article = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or page.name[i] in ("main", "article") and not page.noise[i]:
            holds[page.parent[i]] = True
    for i in range(1, n):
        up = page.parent[i]
        name = page.name[i]
        if page.noise[i] and holds[i] and name not in SKIPPED:
            page.noise[i] = False
        # The header of a page is furniture; that of an article has its title.
        if name == "header" and not in_article[up] and not holds[i]:
            page.noise[i] = True
        page.noise[i] = page.noise[i] or page.noise[up]
        in_article[i] = in_article[up] or name in ("article", "main") and not page.noise[i]


def _densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """Per node its composite density, the sum of its children's, its characters and those inside links."""
    n = len(page.name)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.name[i] == "a" or in_link[page.parent[i]]
    for node, text in page.texts:
        if text and not page.noise[node]:
            size = 0 if text.isspace() else len(text)
            chars[node] += size
            if in_link[node]:
                linked[node] += size
    for i in range(n - 1, 0, -1):
        if not page.noise[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (page.name[i] == "a")
    whole = linked[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if c and not page.noise[i]:
            t, lc, lt = max(tags[i], 1), max(linked[i], 1), max(links[i], 1)
            base = math.log(math.log(c / max(c - linked[i], 1) * linked[i] + whole * c + math.e) + 1.0)
            density[i] = c / t * math.log(c / lc * t / lt + 1.0) / base
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars, linked


def _path(page: Page, node: int) -> list[int]:
    path = [node]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    return path


def article_node(page: Page) -> int:
    """The node that holds the article."""
    density, total, chars, linked = _densities(page)
    if not chars[0]:
        return 0
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    path = _path(page, best)
    threshold = min(density[i] for i in path)
    # Common container of the largest-sum node and of the uppermost nodes that reach the threshold elsewhere.
    marked = [False] * len(density)
    shared = set(path)
    root = best
    for i in range(1, len(density)):
        up = page.parent[i]
        marked[i] = marked[up] or (not page.noise[i] and i not in shared and density[i] >= threshold)
        if marked[i] and not marked[up]:
            while not _inside(page, i, root):
                root = page.parent[root]
    path = _path(page, root)
    for wide in ("article", "main"):
        wider = [i for i in path if page.name[i] == wide]
        if wider:
            return wider[-1]
        # The container may hold the one article instead of standing in it.
        outer, below = [], [False] * len(density)
        for i in range(1, len(density)):
            mine = page.name[i] == wide and not page.noise[i]
            if mine and not below[page.parent[i]]:
                outer.append(i)
            below[i] = mine or below[page.parent[i]]
        if len(outer) == 1 and _inside(page, best, outer[0]) and _inside(page, outer[0], root):
            return outer[0]
    while page.parent[root] > 0 and page.name[root] not in CONTAINERS:
        root = page.parent[root]
    # Without such an element: outwards while what comes in is text rather than links, to the body only for the title.
    titles = [i for i, name in enumerate(page.name) if name == "h1" and not page.noise[i]][:1]
    while (up := page.parent[root]) >= 0:
        more = chars[up] - chars[root]
        if 3 * (linked[up] - linked[root]) > more:
            break
        if page.name[up] in ("", "html", "body") and all(_inside(page, i, root) for i in titles):
            break
        root = up
    return root


def _inside(page: Page, node: int, above: int) -> bool:
    while node > above:
        node = page.parent[node]
    return node == above


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    _settle(page)
    root = article_node(page)
    n = len(page.name)
    inside = [False] * n
    inside[root] = True
    for i in range(root + 1, n):
        inside[i] = inside[page.parent[i]]
    blocks: list[list[str]] = [[]]
    for node, text in page.texts:
        if text is None:
            if blocks[-1]:
                blocks.append([])
        elif inside[node] and not page.noise[node]:
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in joined if x)


def extract(
    pages: DataFrame, *keep: str, html: str = "html", into: str = "text"
) -> DataFrame:
    """(kept columns, main text) of every page, one pass without a shuffle."""
    read = pages.select(*keep, F.col(html).cast("string").alias("_h"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [main_text(h.as_py()) for h in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keep, into])

    return read.mapInArrow(run, T.StructType([*read.schema[:n], T.StructField(into, T.StringType())]))
