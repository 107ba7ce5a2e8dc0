"""Main text of web pages by consensus container paths of their hosts.

Each page is outlined once and its containers are scored by the running text
they hold. The best container's path, generalised to tags and classes with
numbers blanked, is the page's vote. Spark sums votes per host, and each page is
extracted again from the container at its host's winning path, or from its own
best container where that path is missing or empty. Navigation, hidden elements
and the like are left out; forms and elements with names such as sidebar only
where they do not hold what the page is about.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import join_groups, slices, stored

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")

# Elements by role; fixed lists of the markup standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CONTAINER = frozenset("article main section div td body html blockquote center".split())
# What is never article text: by element, by landmark role.
LEFT_OUT = frozenset(
    "nav aside footer head script style textarea title noscript iframe template xmp noembed noframes button "
    "select input svg canvas object menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog".split())
# What is usually not article text: forms, and elements with one of these words in a class or id. Layout wrappers have
# such names too (content-sidebar-wrap), so what such an element holds decides, see Outline._judge.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription sidebar sidenav "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment "
    "comments commentlist disqus respond reply replies share sharing social related recommended widget login "
    "signup search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_SAME_CLOSES = {"li": "li", "option": "option", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}


class Outline:
    """Elements of a page in order, and its texts with the element and block each belongs to."""

    def __init__(self, html: str):
        self.tag = ["#page"]
        self.parent = [-1]
        self.label = ["#page"]
        self.out = [False]
        self.doubted = [False]
        self.leading: list[set | frozenset] = [frozenset()]
        self.last = [0]
        self.linked = [False]
        self.texts: list[tuple[int, int, str]] = []
        self._open = [0]
        self._block = 0
        self._read(html)
        while self._open:
            self.last[self._open.pop()] = len(self.tag) - 1
        self._judge()

    def _close(self) -> None:
        node = self._open.pop()
        self.last[node] = len(self.tag) - 1
        if self.tag[node] in BLOCK:
            self._block += 1

    def _close_to(self, names: frozenset | set, stop: frozenset) -> None:
        """Closes up to the nearest open element of these names, unless one of ``stop`` comes first."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in stop:
                return

    def _start(self, tag: str, raw: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_to({"p"}, CONTAINER | {"table", "button", "li"})
        if tag in _SAME_CLOSES:
            self._close_to(set(_SAME_CLOSES[tag].split()), frozenset(("ul", "ol", "dl", "table", "select", "article", "section")))
        if tag in BLOCK:
            self._block += 1
        if tag in VOID:
            if tag == "br" and self.texts:
                self.texts.append((self._open[-1], self._block, " "))
            return
        names, ident, role, hidden = "", "", "", False
        if raw and not raw.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                name, value = name.lower(), a or b or c
                if name == "class":
                    names = value.lower()
                elif name == "id":
                    ident = value.lower()
                elif name == "role":
                    role = value.lower()
                elif name == "hidden":
                    hidden = True
                elif name == "style":
                    hidden |= "display:none" in value.lower().replace(" ", "")
        up = self._open[-1]
        classes = names.split()
        bad = tag in LEFT_OUT or hidden or role in ROLES
        doubted = tag == "form" or role == "form"
        leading: set | frozenset = frozenset()
        if (classes or ident) and not bad and tag not in ("body", "html"):
            words = [_WORD.findall(c) for c in classes]
            by_id = [_WORD.findall(c) for c in ident.split()]
            leading = {w[0] for w in words + by_id if w}
            doubted |= any(w in NAMES for c in (by_id if tag in ("article", "main") else words + by_id) for w in c)
        if tag == "header" and not any(self.tag[n] in ("article", "main") for n in self._open):
            bad = True
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.label.append(".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})]))
        self.out.append(bad or self.out[up])
        self.doubted.append(doubted)
        self.leading.append(leading)
        self.linked.append(tag == "a" or self.linked[up])
        self.last.append(node)
        self._open.append(node)

    def _read(self, html: str) -> None:
        at, find = 0, _TAG.search
        while True:
            match = find(html, at)
            if match is None:
                break
            if match.start() > at:
                self.texts.append((self._open[-1], self._block, html[at : match.start()]))
            at = match.end()
            close, tag, raw = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag == "p" and not any(self.tag[n] == "p" for n in self._open):
                    self._block += 1
                self._close_to({tag}, frozenset() if tag in BLOCK else CONTAINER)
                continue
            self._start(tag, raw)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*>|\Z", re.I).search(html, at)
                at = end.end()
                self._close()
        if at < len(html):
            self.texts.append((self._open[-1], self._block, html[at:]))

    def _judge(self) -> None:
        """Leaves out doubted elements, but not those that hold what the page is about.

        That is the ``main`` with most running text; without one, the largest
        article that is not named like a comment or teaser, if it holds as much as
        all text outside doubted elements. An element with over half of the running
        text of the page, or of the main or article it is in, stays as well. Comments
        may well outgrow their article, so they need nine tenths, and no such main or
        article on the page.
        """
        if True not in self.doubted:
            return
        count = len(self.tag)
        under = [False] * count
        for node in range(1, count):
            under[node] = self.doubted[node] or under[self.parent[node]]
        size, plain = [0.0] * count, 0.0
        for node, _, text in self.texts:
            if not self.out[node]:
                length = len(text.strip()) * (0.1 if self.linked[node] else 1.0)
                size[node] += length
                plain += 0.0 if under[node] else length
        for node in range(count - 1, 0, -1):
            size[self.parent[node]] += size[node]
        mains = [n for n in range(1, count) if self.tag[n] == "main" and size[n] > 0]
        focus = max(mains, key=lambda n: (size[n], -n), default=0)
        if not focus:
            articles = [n for n in range(1, count) if self.tag[n] == "article" and size[n] > 0 and not self.leading[n] & NAMES]
            focus = max(articles, key=lambda n: (size[n], -n), default=0)
            focus = focus if size[focus] >= plain else 0
        for node in range(1, count):
            if self.doubted[node] and not self.out[node]:
                stays = focus and node <= focus <= self.last[node]
                if not stays and self.leading[node] & COMMENTS:
                    stays = not focus and size[node] > 0.9 * size[0]
                elif not stays:
                    inside = focus and focus < node <= self.last[focus]
                    stays = size[node] > 0.5 * size[focus if inside else 0]
                self.out[node] = not stays
            self.out[node] |= self.out[self.parent[node]]

    def path(self, node: int) -> str:
        parts = []
        while node > 0:
            if self.tag[node] != "html":
                parts.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(parts))

    def scores(self) -> dict[int, float]:
        """Running text of each container: its own in full, that of containers inside it by half."""
        own: dict[int, float] = {}
        for node, _, text in self.texts:
            if self.out[node]:
                continue
            size = len(text.strip())
            if not size:
                continue
            weight = 0.1 if self.linked[node] else 1.0
            while node > 0 and self.tag[node] not in CONTAINER:
                node = self.parent[node]
            own[node] = own.get(node, 0.0) + size * weight
        total = dict(own)
        for node, size in own.items():
            up = self.parent[node]
            while up > 0 and self.tag[up] not in CONTAINER:
                up = self.parent[up]
            if up >= 0:
                total[up] = total.get(up, 0.0) + size / 2
        return {n: s * (2.0 if self.tag[n] in ("article", "main") else 1.0) for n, s in total.items()}

    def best(self) -> tuple[int, float]:
        """The container with the highest score, the first of equals; the page itself where there is no text."""
        scores = self.scores()
        if not scores:
            return 0, 0.0
        node = max(scores, key=lambda n: (scores[n], -n))
        return node, scores[node]

    def at_path(self, path: str) -> list[int]:
        """Containers with this path, outermost only."""
        tail = path.rsplit(">", 1)[-1]
        found, after = [], -1
        for node in range(1, len(self.tag)):
            if node > after and self.label[node] == tail and not self.out[node] and self.path(node) == path:
                found.append(node)
                after = self.last[node]
        return found

    def text(self, nodes: list[int]) -> str:
        """Blocks below the given elements, white space folded, one block a line."""
        lines: list[str] = []
        parts: list[str] = []
        block = -1
        ranges = [(n, self.last[n]) for n in nodes]
        for node, number, text in self.texts:
            if self.out[node] or not any(a <= node <= b for a, b in ranges):
                continue
            if number != block and parts:
                lines.append(" ".join(unescape("".join(parts)).split()))
                parts = []
            block = number
            parts.append(text)
        if parts:
            lines.append(" ".join(unescape("".join(parts)).split()))
        return "\n".join(line for line in lines if line)


def vote(html: str) -> tuple[str, float]:
    """Generalised path of the page's best container and its score."""
    page = Outline(html)
    node, score = page.best()
    return page.path(node), score


def extract(html: str, path: str | None) -> str:
    """Text at the host's path, else of the page's own best container."""
    page = Outline(html)
    if path:
        text = page.text(page.at_path(path))
        if text:
            return text
    node, score = page.best()
    return page.text([node]) if score else ""


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text), one row per page.

    Null and empty pages give an empty text and no vote. Pages without a host
    share the empty host. Votes are counted per host and path with partial sums;
    the path with most votes wins, then the higher score, then the later path.
    Repeated rows vote and return each. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        host.alias("host"),
    )

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [vote(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("host"),
                    pa.array([p for p, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["host", "path", "score"],
            )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [
                extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"]
            )

    counted = (
        rows.select("host", "html")
        .mapInArrow(votes, "host string, path string, score double")
        .groupBy("host", "path")
        .agg(F.count("*").alias("pages"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    )
    winners = stored(
        counted.groupBy("host")
        .agg(F.sum("pages").alias("_pages"), F.max(F.struct("votes", "score", "path")).alias("best"))
        .select("host", "_pages", F.when(F.col("best.votes") > 0, F.col("best.path")).alias("path")),
        "page-paths",
    )
    total = winners.agg(F.sum("_pages")).first()[0] or 0
    met = join_groups(rows, winners, ["host"], "_pages", total).select("page_id", "url", "html", "path")
    kinds = {c: pages.schema[n].dataType.simpleString() for c, n in (("page_id", page_id), ("url", url))}
    return met.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
