"""Operator 8: main text of web pages by tag-path ratios.

A page is cut into text nodes with root-to-leaf tag paths. Per path the text length and the punctuation are averaged
over its nodes; both ratios are smoothed over the nodes in page order (which lowers, but never lifts a path's own), fused
by their product and held against a share of their mean by characters. Nodes under it are dropped, but for what stands
between two runs of content in their parent block (captions, short items), the headings before those, and all text of
articles and mains that hold most of the content. The parent block with most content is the main one; elsewhere a path is
content only if it holds half as many characters as the largest path. Scripts, styles, menus, headers, footers, sidebars
and the like are never read where their tags say so. Forms and elements told by class, id or role are evidence: one with
more content than there is outside of all of them is a wrapper and is read if it holds the first article or main, on pages
without these the first h1, and without that if there is no other content at all.

Defined results: null, empty and text-free html give an empty text; unclosed and misnested tags
close as in browsers where that is needed here; html cut off inside a tag drops that tag only.
Whole pages are read, in time that grows with their length, however deep they are nested. Repeated rows are alike.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Block elements of HTML, each of which ends a run of text.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav header footer aside form script style noscript template head title button select option textarea iframe svg math object dialog menu label input fieldset".split())
WRAPPERS = frozenset(("form", "fieldset"))
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "li", "dd", "dt", "option", "title"}
NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|banner|promo|promotion|sponsor(?:ed)?|side-?bar|aside|menu|nav|navbar|navigation|breadcrumbs?|foot|footer|masthead|site-?header|page-?header|top-?bar|comments?|comment-?list|replies|reply|disqus|respond|notice|notices|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|widget|pagination|pager|toolbar|legal|copyright|disclaimer|skip)(?:$|[^a-z])"
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROOTS = ("article", "main")
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"))
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。，、]")


#: A path that holds this share of the characters of the largest one is content outside of the main block, too.
SHARE = 0.5
#: Of the mean score by characters, what a path needs.
LEAST = 0.3
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    """An element; what its text needs to know of its ancestors is handed down, so that depth costs nothing."""

    __slots__ = ("tag", "parent", "path", "dropped", "marked", "mark", "top", "home")

    def __init__(self, tag: str, parent: "Node | None", paths: dict, dropped: bool, root: bool, marked: bool = False):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.path = paths.setdefault((parent.path if parent else -1, tag), len(paths))
        self.mark = self if marked else parent.mark if parent else None  # the nearest marked element
        self.top = parent.top if parent and parent.top else self if root else None  # the outermost article or main
        self.home = self if tag in BLOCK or not parent else parent.home  # the nearest block


def _evidence(tag: str, attributes: str) -> tuple[bool, bool]:
    """(dropped whatever its ratios, told by names to be no main text)."""
    dropped, marked = tag in DROPPED and tag not in WRAPPERS, tag in WRAPPERS
    if not attributes or tag in ("html", "body", "article", "main"):
        return dropped, marked
    for name, a, b, c in ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and value and NAMES.search(re.sub(r"_", "-", value)) or name == "role" and value in ROLES:
            marked = True
        if name == "aria-hidden" and value == "true" or name == "hidden":
            dropped = True
    return dropped, marked


def text_nodes(page: str) -> list[tuple[Node, str, int]]:
    """(element, decoded text, block) of a page's text in page order; equal blocks are one run."""
    out: list[tuple[Node, str, int]] = []
    paths: dict[tuple[int, str], int] = {}
    node = Node("#", None, paths, False, False)
    at, block, size, open_tags = 0, 0, len(page), Counter()

    def closed(node: Node, upto: Node) -> Node:
        """``upto``'s parent, after all from ``node`` to ``upto`` are closed."""
        while node is not upto.parent:
            open_tags[node.tag] -= 1
            node = node.parent
        return node

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            out.append((node, text, block))
        if not m:
            break
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                out.append((node, m[0][9:].removesuffix("]]>"), block))
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            up = node
            while open_tags[tag] and up.tag != tag:
                if up.tag in ("td", "th", "table") and tag not in BLOCK:
                    break
                up = up.parent
            if up.tag == tag and up.parent:
                node = closed(node, up)
            continue
        if tag in ENDS_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("p",))
            up = node
            while any(open_tags[t] for t in closes) and up.parent and up.tag not in closes and up.tag not in ("div", "article", "section", "main", "body", "table", "ul", "ol", "dl", "nav", "aside", "footer", "header", "form", "select", "button"):
                up = up.parent
            if up.tag in closes and up.parent:
                node = closed(node, up)
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        dropped, marked = _evidence(tag, m[3])
        node = Node(tag, node, paths, node.dropped or dropped, tag in ROOTS, marked)
        open_tags[tag] += 1
    return [(n, SPACE.sub(" ", htmllib.unescape(t)), b) for n, t, b in out]


def tag_path_scores(nodes: list[tuple[Node, str, int]]) -> tuple[np.ndarray, float]:
    """The fused, smoothed tag-path ratio of each node, and the threshold."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text, _ in nodes:
        chars[node.path] += len(text)
        marks[node.path] += len(PUNCTUATION.findall(text))
        count[node.path] += 1
    raw = [np.array([x[n.path] / count[n.path] for n, _, _ in nodes], dtype=float) for x in (chars, marks)]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = [np.convolve(np.pad(x, 2, mode="edge"), kernel, mode="valid") for x in raw]
    # a long path among short ones is lowered, a short one next to long ones isn't lifted
    fused = np.minimum(np.sqrt(smooth[0] * smooth[1]), np.sqrt(raw[0] * raw[1]))
    sizes = np.array([len(t) for _, t, _ in nodes], dtype=float)
    return fused, float(LEAST * (fused * sizes).sum() / sizes.sum())


def _chain(node: Node) -> list[Node]:
    """The marked elements round a node, the outermost first."""
    out, mark = [], node.mark
    while mark:
        out.append(mark)
        mark = mark.parent.mark if mark.parent else None
    return out[::-1]


def _under(node: Node, upper: Node, known: dict[tuple[int, int], bool]) -> bool:
    """Whether ``upper`` is ``node`` or round it; each element is walked once for each ``upper``."""
    walked, found = [], None
    while node is not None and found is None:
        walked.append(id(node))
        found = known.get((id(node), id(upper)), True if node is upper else None)
        node = node.parent
    for x in walked:
        known[x, id(upper)] = bool(found)
    return bool(found)


def _marks(nodes: list[tuple[Node, str, int]], content: list[tuple[Node, int]]) -> set[int]:
    """The marked elements that are read, as they wrap the content."""
    first = next((n.top for n, _, _ in nodes if n.top), None) or next((n.home for n, _, _ in nodes if n.home.tag == "h1"), None)
    first_marks = {id(x) for x in _chain(first)} if first else set()
    chains: dict[int, list[Node]] = {}
    for node, _ in content:
        mark = id(node.mark)
        if mark not in chains:
            chains[mark] = _chain(node)
    at = dict.fromkeys(chains, 0)
    read: set[int] = set()
    while True:
        outside, inside = 0, defaultdict(int)
        for node, size in content:
            chain, k = chains[id(node.mark)], at[id(node.mark)]
            while k < len(chain) and id(chain[k]) in read:
                k += 1
            at[id(node.mark)] = k
            if k == len(chain):
                outside += size
            else:
                inside[id(chain[k])] += size
        most = max(inside, key=inside.get, default=None)
        if most is None or inside[most] <= outside or (outside if first is None else most not in first_marks):
            return read
        read.add(most)


def _stretches(runs: list[list], known: dict) -> None:
    """Emits, between a parent block's first and last run of content, what else stands there, from the heading before them on.

    A run is [parent block, is content, is a heading, texts, is emitted].
    """
    ends: dict[int, list[int]] = {}
    for k, run in enumerate(runs):
        if run[1]:
            ends.setdefault(id(run[0]), [k, k])[1] = k
    for first, last in ends.values():
        parent, start = runs[first][0], first
        while start > 0 and not runs[start - 1][1] and not runs[start - 1][2] and _under(runs[start - 1][0], parent, known):
            start -= 1
        if start == 0 or not runs[start - 1][2]:
            start = first  # no heading leads there
        while start > 0 and runs[start - 1][2] and not runs[start - 1][1] and (_under(runs[start - 1][0], parent, known) or _under(parent, runs[start - 1][0], known)):
            start -= 1
        for run in runs[start : last + 1]:
            if run[2] or _under(run[0], parent, known):
                run[4] = True


def main_text(page: str | None) -> str:
    nodes = [x for x in text_nodes(page or "") if not x[0].dropped and x[1]]
    full = [x for x in nodes if x[1].strip()]
    if not full:
        return ""
    fused, threshold = tag_path_scores(full)
    over = [(x, score) for x, score in zip(full, fused) if score >= threshold or len(full) == 1]
    read = _marks(full, [(x[0], len(x[1])) for x, score in over if score > 0])
    clear: dict[int, bool] = {id(None): True}

    def clean(node: Node) -> bool:
        mark = id(node.mark)
        if mark not in clear:
            clear[mark] = all(id(x) in read for x in _chain(node))
        return clear[mark]

    content = [(x[0], len(x[1])) for x, _ in over if clean(x[0])]
    if not content:
        return ""
    # the block with most content is the main one; elsewhere only paths that hold much of it are content
    mass, within, known = defaultdict(int), defaultdict(int), {}
    for node, size in content:
        mass[node.path] += size
        within[id(node.home.parent or node.home)] += size
    most, main = max(mass.values()), max(within, key=within.get)
    main = next(n.home.parent or n.home for n, _ in content if id(n.home.parent or n.home) == main)
    content = [(n, size) for n, size in content if n.top or mass[n.path] >= SHARE * most or _under(n, main, known)]
    kept = {id(n) for n, _ in content}
    told = {(id(x[0]), x[2]) for x, _ in over if id(x[0]) in kept}
    in_roots = sum(size for node, size in content if node.top)
    homes = {id(node.top) for node, _ in content if node.top}
    whole = 2 * in_roots > sum(size for _, size in content)  # articles and mains hold most: they are read as they are
    runs: list[list] = []
    last = None
    for node, text, block in nodes:
        if not clean(node):
            continue
        own = (id(node), block) in told
        if block != last or not runs:
            home = node.home
            runs.append([home.parent or home, False, home.tag in HEADINGS, [], False])
            last = block
        run = runs[-1]
        run[1] = run[1] or own
        run[3].append(text)
        run[4] = run[4] or own or whole and node.top is not None and id(node.top) in homes
    runs = [r for r in runs if r[4] or any(t.strip() for t in r[3])]
    if not whole:
        _stretches(runs, known)
    joined = (SPACE.sub(" ", "".join(run[3])).strip() for run in runs if run[4])
    return " ".join(x for x in joined if x)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with text and n_chars (replacing columns of those names)."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    out = df.withColumn("text", run(F.coalesce(F.col(html), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
