"""Main text of web pages by consensus paths of each host.

Pass 1 reads each page's tree, scores its containers by the running text of their own
paragraphs, and lets the best one vote for its generalised path (tags with their
classes, digits replaced). Spark adds up the votes by (host, path), combined before
the shuffle, so a host with a third of all pages is a few rows. Paths with at least a
twentieth of a host's votes win: at most twenty a host. Pass 2 reads the pages again and takes
the text of the first winning path a page has; a page that has none keeps its own best container.
Inside the container, menus, notices, adverts, forms and the like are left out.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import cut, table

#: Share of a host's votes that makes a path a winner.
SHARE = 0.05

# Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea", "select", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br".split()
)
CONTAINERS = frozenset("body div main article section td center blockquote content table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form menu button dialog fieldset".split())
# Parts of class names and identifiers that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navigation navbar menu menus submenu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommend recommended recommendations comment comments disqus discussion respond reply replies pagination pager widget "
    "widgets toolbar skip copyright disclaimer form search sitemap toc tags hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog note".split())
SCOPES = frozenset("body article main section div td table".split())
CONDITIONS = frozenset("has with without no is".split())

#: A quote opens a value only right after its equals sign; elsewhere it is a character like others, as is one that never closes.
_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')?|[^>=]++)*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element: its step in the path of containers and that path's length, whether it is left out, and which element it stands in."""

    __slots__ = ("tag", "parent", "step", "size", "out", "header", "link")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent, self.step = tag, parent, ""
        self.out = tag in DROPPED or (parent.out if parent else False)
        self.header = tag == "header" or (parent.header if parent else False)
        self.link = tag == "a" or (parent.link if parent else False)
        names = ""
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = references.unescape(found.get("class", ""))
            if tag not in ("html", "body", "main", "article"):
                self._mark(f"{names} {found.get('id', '')}", found)
        if tag in CONTAINERS:
            kept = ".".join(sorted(set(_DIGITS.sub("#", names).split())))
            self.step = f"/{tag}.{kept}" if kept else f"/{tag}"
        self.size = len(self.step) + (parent.size if parent else 0)

    @property
    def path(self) -> str:
        """Built when asked for: with every element's path at hand, deep pages would take memory by the square of their depth."""
        return "".join([n.step for n in _chain(self)][::-1])

    def _mark(self, names: str, found: dict[str, str]) -> None:
        style = found.get("style", "").replace(" ", "").lower()
        if found.get("role", "").lower() in ROLES or "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true":
            self.out = True
        for name in names.split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if CONDITIONS.isdisjoint(parts):
                self.out = self.out or not MARKS.isdisjoint(parts)
                self.header = self.header or "header" in parts


def blocks(page: str) -> list[tuple[Node, bool, str, int]]:
    """(element, is a heading, text, length of its link text) of each block of running text, in page order."""
    out: list[tuple[Node, bool, str, int]] = []
    root = Node("html", None, "")
    stack = [root]
    pending: list[tuple[str, bool]] = []
    at, owner = 0, root

    def flush() -> None:
        if pending:
            text = " ".join("".join(t for t, _ in pending).split())
            if text:
                links = sum(len(t) for t, link in pending if link)
                out.append((owner, any(n.tag in HEADINGS for n in _chain(owner)), text, links))
            pending.clear()

    def add(text: str) -> None:
        nonlocal owner
        if text:
            if not pending or pending_is_blank():
                owner = block_of(stack[-1])
            if not stack[-1].out or owner.out:
                pending.append((references.unescape(text) if "&" in text else text, stack[-1].link))

    def pending_is_blank() -> bool:
        return all(t.isspace() for t, _ in pending)

    while True:
        found = _MARKUP.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in INLINE:
                close(stack, tag)
            else:
                flush()
                close(stack, tag)
            continue
        if tag == "br":
            pending.append((" ", False))
            continue
        if tag not in INLINE:
            flush()
            make_room(stack, tag)
        if tag in _RAW_END:
            if not found[3].rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        stack.append(Node(tag, stack[-1], found[3]))
    flush()
    return out


def _chain(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def block_of(node: Node) -> Node:
    """The nearest element that is not inline."""
    while node.tag in INLINE and node.parent:
        node = node.parent
    return node


def close(stack: list[Node], tag: str) -> None:
    """End tag: close up to the nearest open element of that name; an inline one never closes a container."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE:
            return
        if tag not in SCOPES and stack[i].tag in SCOPES and tag not in ("html",):
            return


def make_room(stack: list[Node], tag: str) -> None:
    """A block-level start tag ends an open paragraph; list items, cells and rows end their like."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "body": ("head",)}.get(tag, ())
    for i in range(len(stack) - 1, 0, -1):
        node = stack[i]
        if node.tag == "p" or node.tag in ends or (node.tag in HEADINGS and tag in HEADINGS):
            del stack[i:]
            if node.tag == "p" and ends:
                continue
            return
        if node.tag not in INLINE and not (ends and node.tag not in SCOPES and node.tag not in ("ul", "ol", "dl", "table")):
            return


def _wanted(node: Node, heading: bool) -> bool:
    """Text outside menus, notices and so on; of a header, its headings only, and those only in an article or main part."""
    if node.out:
        return False
    return not node.header or (heading and any(n.tag in ("article", "main") for n in _chain(node)))


def scores(found: list[tuple[Node, bool, str, int]]) -> dict[str, int]:
    """Score of each container path of a page: its own running text without links, and half of its inner containers'."""
    points: dict[str, int] = {}
    for node, heading, text, links in found:
        if heading or not _wanted(node, heading):
            continue
        gain = len(text) - 2 * links
        holders = [n for n in _chain(node) if n.tag in CONTAINERS]
        for depth, holder in enumerate(holders[:3]):
            bonus = 3 if holder.tag in ("article", "main") else 2
            points[holder.path] = points.get(holder.path, 0) + (gain * bonus >> depth)
    return points


def best_path(points: dict[str, int]) -> str | None:
    return min(points, key=lambda p: (-points[p], len(p), p)) if points else None


def text_of(found: list[tuple[Node, bool, str, int]], path: str | None) -> str:
    """Blocks inside the containers with that path, in page order; without a path, the whole page."""

    def inside(node: Node) -> bool:
        return path is None or any(n.step and n.size == len(path) and n.path == path for n in _chain(node))

    return "\n".join(text for node, heading, text, _ in found if _wanted(node, heading) and inside(node))


def extract(page: str | None, winners: list[str] | None) -> tuple[str, str | None]:
    """(main text, path used) of one page."""
    found = blocks(page or "")
    for path in winners or []:
        text = text_of(found, path)
        if text:
            return text, path
    path = best_path(scores(found))
    return text_of(found, path), path


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): host in lower case, empty where the url has none."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", "html", F.lower(host).alias("host"))


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the winning paths of each host, best first. Input: (host, html)."""

    def votes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1)):
                points = scores(blocks(page.as_py() or ""))
                path = best_path(points)
                if path is not None and points[path] > 0:
                    rows.append((host, path, points[path]))
            hosts, paths, gains = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(gains, pa.int64())], ["host", "path", "score"])

    cast = pages.select("host", "html").mapInArrow(votes, "host string, path string, score bigint")
    counted = cut(cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "votes")
    cast_by = counted.groupBy("host").agg(F.sum("n").alias("all"))
    won = counted.join(cast_by, "host").filter(F.col("n") >= share * F.col("all"))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path"))).alias("won"))
    return ranked.select("host", F.col("won.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of (page_id, url, html).

    Returns page_id, url, text, n_chars (code points), path. A null or empty page, and one without running
    text, has an empty text; cut-off pages count as if all their elements ended there;
    repeated rows are extracted each; a url without host belongs to the host
    ''. Texts of any length are read whole. An empty table gives no rows; other columns are not read.
    """
    hosted = with_host(pages)
    winners = cut(winning_paths(hosted), "winners").withColumnRenamed("host", "won_host")
    joined = hosted.join(winners, hosted["host"] == F.col("won_host"), "left")

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [extract(page.as_py(), paths.as_py()) for page, paths in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([p for _, p in done], pa.string())],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    return joined.select(F.col("page_id").cast("bigint"), "url", "html", "paths").mapInArrow(
        texts, "page_id bigint, url string, text string, n_chars bigint, path string"
    )


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
