"""Main text of web pages by site style trees.

After Yi, Liu and Li, "Eliminating noisy information in web pages" (KDD 2003). The DOMs of a host's pages
are merged by tag path. A merged node's presentation importance is the entropy of its child sequences over
the pages that have it, its content importance one minus the mean entropy of its content features; an inner
node combines its own importance with its children's, damped by depth. Branches that are of low importance
in all their nodes, which look and read alike on page after page, are cut from each page, inside an article
too. Few pages are little evidence: there a branch must be closer to alike. Siblings of one tag share a path,
so a block that repeats beside them is told by its whole line, where the host has pages enough. The markup is
used besides: menus, headers, footers, forms, notices and the like are cut by element and by class word, and
an article or main element, where there is one, bounds the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import scratch
from palimpsest.llm.memory import trimmed


@dataclass(frozen=True)
class Settings:
    """Damping of a node's own importance by its children, least importance of a kept branch or line,
    distinct pages from which that least importance holds in full (below them it falls in proportion, to none
    at one page, and lines are not judged), and salts of the join with a host's noise."""

    gamma: float = 0.9
    least: float = 0.2
    min_pages: int = 8
    salts: int = 16


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
NOISE = frozenset("script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu head title audio video".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"} | {"li"}
_ENDS_SELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_HOLDS = frozenset("body div section article main aside nav header footer form table ul ol dl blockquote figure td th".split())
_NOISE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-?bar|aside|widget|cookies?|consent|gdpr|notice|popup|modal|overlay|subscribe|newsletter|signup|share|sharing|social|related|recommend\w*|comments?|respond|replies|disqus|discussion|pagination|pager|skip-?link|toolbar|legal|copyright)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())


class Node:
    __slots__ = ("tag", "label", "noise", "children", "parent")

    def __init__(self, tag: str, label: str, noise: bool, parent: Node | None):
        self.tag, self.label, self.noise, self.parent = tag, label, noise, parent
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    """A forgiving tree builder: implied ends of paragraphs and list items, stray ends ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#", "", False, None)

    def _close(self, tags: tuple[str, ...]) -> None:
        n = self.now
        while n is not self.root and n.tag not in tags:
            if n.tag in _HOLDS:
                return
            n = n.parent
        if n is not self.root:
            self.now = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close(("p",))
        if tag in _ENDS_SELF:
            self._close(_ENDS_SELF[tag])
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        hidden = "hidden" in a or a.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) is not None
        noise = tag in NOISE or hidden or a.get("role", "").lower() in _ROLES or (tag not in ("html", "body", "article", "main") and _NOISE_WORD.search(names) is not None)
        node = Node(tag, f"{tag}.{'.'.join(sorted(a.get('class', '').split()))}", noise, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag:
            self.now = self.now.parent

    def handle_endtag(self, tag):
        n = self.now
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.now = n.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_nodes(root: Node) -> Iterator[tuple[int, int, int, int, int]]:
    """(path, parent path, depth, kind, feature) of a page, each once; kind 0 is the child sequence, 1 a text, 2 the path itself."""
    seen, todo = set(), [(root, _digest("#"), 0, 0)]
    while todo:
        node, path, parent, depth = todo.pop()
        below = [c for c in node.children if isinstance(c, Node)]
        labels = [c.label for c in below]
        sequence = " ".join(x for k, x in enumerate(labels) if k == 0 or labels[k - 1] != x)
        rows = {(path, parent, depth, 0, _digest(sequence)), (path, parent, depth, 2, 0)}
        rows |= {(path, parent, depth, 1, _digest(" ".join(c.split()))) for c in node.children if isinstance(c, str) and c.strip()}
        yield from rows - seen
        seen |= rows
        todo += [(c, _digest(f"{path}>{c.label}"), path, depth + 1) for c in below]


def main_text(root: Node, noise: frozenset[int] | set[int] = frozenset(), lines: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the page's main text, one a line; ``noise`` holds paths that the site's style tree cuts,
    ``lines`` digests of whole lines."""
    found: list[tuple[Node, int]] = []
    todo = [(root, _digest("#"))]
    while todo:
        node, path = todo.pop()
        if node.noise:
            continue
        if node.tag in ("article", "main"):
            found.append((node, path))
            continue
        todo += [(c, _digest(f"{path}>{c.label}")) for c in reversed(node.children) if isinstance(c, Node)]
    blocks, words = [], []

    def end() -> None:
        line = " ".join("".join(words).split())
        words.clear()
        if line and not (lines and _digest(line) in lines):
            blocks.append(line)

    for top in found or [(root, _digest("#"))]:
        todo = [(*top, False)]
        while todo:
            x, path, done = todo.pop()
            if isinstance(x, str):
                words.append(x)
            elif done:
                end()
            elif path in noise:
                if x.tag in BLOCK:
                    end()
            elif not x.noise:
                if x.tag == "br":
                    words.append(" ")
                if x.tag in BLOCK:
                    end()
                    todo.append((x, path, True))
                todo += [(c, _digest(f"{path}>{c.label}") if isinstance(c, Node) and noise else 0, False) for c in reversed(x.children)]
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "page", "path", "parent", "depth", "kind", "feature"]
    for batch in batches:
        rows: list[tuple] = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if html:
                root = parse(html)
                text = main_text(root)
                host, page = host_of(url), _digest(text or html)
                rows += [(host, page, *x) for x in style_nodes(root)]
                rows += [(host, page, 0, 0, 0, 3, _digest(line)) for line in set(text.split("\n")) if line]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)


def _noise_of_host(s: Settings):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Paths of the topmost branches that are below the least importance throughout, from a host's merged nodes."""
        nodes = {r.path: r for r in pdf.itertuples()}
        below: dict[int, list[int]] = {}
        for r in nodes.values():
            below.setdefault(r.parent, []).append(r.path)
        importance: dict[int, float] = {}
        low: dict[int, bool] = {}
        texts: dict[int, int] = {}
        for path in sorted(nodes, key=lambda p: -nodes[p].depth):
            r = nodes[path]
            kids = [c for c in below.get(path, ()) if c in importance]
            texts[path] = r.texts + sum(texts[c] for c in kids)
            damp = s.gamma ** len(kids)
            importance[path] = (1 - damp) * r.presentation + damp * max(importance[c] for c in kids) if kids else r.content
            # a node's own texts count beside its children
            if kids and r.texts:
                importance[path] = max(importance[path], r.content)
            least = s.least * min(1.0, (r.m - 1) / max(1, s.min_pages - 1))
            low[path] = all(low[c] for c in kids) and (importance[path] < least or not texts[path])
        tops = [p for p in nodes if nodes[p].parent not in nodes]
        out, todo = [], list(tops)
        while todo:
            p = todo.pop()
            if not low[p]:
                todo += below.get(p, ())
            elif texts[p]:
                out.append(p)
        # what the few pages of a host share is a template only beside texts in which they differ
        few = max(nodes[p].m for p in tops) < s.min_pages
        if few and 2 * sum(texts[p] for p in out) > sum(texts[p] for p in tops):
            out = []
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "noise": [out]})

    return run


def site_noise(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, noise, lines) with the paths that a host's style tree cuts, and the digests of repeated lines; ``pages`` has url and html.

    Counts are aggregated before anything is gathered: what a task sees of a host is its merged tree.
    """
    s = settings
    kinds = "host string, page bigint, path bigint, parent bigint, depth int, kind int, feature bigint"
    rows = pages.select("url", "html").mapInArrow(trimmed(_survey), kinds)
    # pages of equal main text count once: copies of a page are not a template
    counts = rows.groupBy("host", "path", "kind", "feature").agg(F.count_distinct("page").alias("c"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    counts = scratch.materialise(counts, "style_counts")
    pages_of = counts.filter("kind = 2").select("host", "path", F.col("c").alias("m"))
    # features of equal counts weigh the same: a path on a third of all pages is as many rows as it has counts
    equal = counts.filter("kind < 2").groupBy("host", "path", "kind", "c").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    joined = equal.join(pages_of, ["host", "path"]).withColumn("p", F.least(F.col("c") / F.greatest("m", F.lit(1)), F.lit(1.0)))
    log_m = F.log2(F.greatest(F.col("m"), F.lit(2)))
    text = F.col("kind") == 1
    # a feature on c of m pages spreads evenly over c of them: its entropy is log(c) / log(m)
    nodes = joined.groupBy("host", "path").agg(
        F.min("parent").alias("parent"),
        F.min("depth").alias("depth"),
        F.max("m").alias("m"),
        F.coalesce(F.sum(F.when(text, F.col("n"))), F.lit(0)).alias("texts"),
        F.coalesce(F.sum(F.when(F.col("kind") == 0, -F.col("n") * F.col("p") * F.log2("p") / log_m)), F.lit(0.0)).alias("presentation"),
        F.coalesce(1 - F.sum(F.when(text, F.col("n") * F.least(F.log2("c") / log_m, F.lit(1.0)))) / F.sum(F.when(text, F.col("n"))), F.lit(0.0)).alias("content"),
    )
    paths = nodes.groupBy("host").applyInPandas(_noise_of_host(s), "host string, noise array<bigint>")
    whole = pages_of.filter(F.col("path") == _digest("#")).select("host", "m").filter(F.col("m") >= s.min_pages)
    lines = counts.filter("kind = 3 and c > 1").join(whole, "host").filter(1 - F.log2("c") / log_m < s.least)
    return paths.join(lines.groupBy("host").agg(F.collect_list("feature").alias("lines")), "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        noise, lines, html = (batch.column(c).to_pylist() for c in ("_noise", "_lines", "_html"))
        texts = [main_text(parse(h), frozenset(n or ()), frozenset(x or ())) if h else "" for n, x, h in zip(noise, lines, html, strict=True)]
        kept = [c for c in batch.schema.names if c not in ("_noise", "_lines", "_html")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], [*kept, "text"])


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], [*batch.schema.names, "_host"])


def extract_main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html).

    White space inside a block becomes one blank, blocks are trimmed and joined by one line break in page
    order. Null and empty html give an empty text; a null or broken url is a host of its own name, the empty
    one; repeated rows are extracted each for itself. Other columns are ignored.
    """
    s = settings
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    noise = scratch.materialise(site_noise(pages, s).filter("size(noise) > 0 or lines is not null"), "site_noise")
    # a host may have a third of all pages: its few noise rows are repeated, its pages dealt over them
    noise = noise.select(F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("_salt"), F.col("noise").alias("_noise"), F.col("lines").alias("_lines"))
    rows = pages.mapInArrow(trimmed(_hosts), "page_id bigint, url string, html string, _host string")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(s.salts)).cast("int")).join(noise, ["_host", "_salt"], "left")
    return rows.select("page_id", "url", F.col("html").alias("_html"), "_noise", "_lines").mapInArrow(trimmed(_extract), "page_id bigint, url string, text string")
