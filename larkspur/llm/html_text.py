"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each under the path of block elements from the root to it (inline elements
are part of their block). Per path, the text length outside links and the punctuation are summed and divided by the
path's blocks; both ratios are laid along the page in block order, smoothed, fused by their product, and paths whose
mean reaches the threshold are content paths. The content node is the deepest element that holds most of the text on
content paths. It is taken whole, with the article or main element around it, but for paths under the threshold that
are also named like something else (a menu, an advert) or, beside the content node, are links for the most part, and for
what is marked as such outright.

Navigation, headers, footers, asides, forms, scripts, styles and hidden elements are no text by their elements or
roles. A token of a class or id that is such a name as a whole ("ad", "cookie-notice") marks an element unless that is a
heading; a part of a class ("ad-slot", "social-policy") is a hint, which lowers the path's ratios and counts only where
they stay under the threshold. An article or main element raises them.

Pages are worked on one by one inside Arrow batches: no shuffle, so a hot host or a very long page moves nothing.

Defined cases: null or empty html gives an empty text; a tag cut off at the end is markup and is left out, a character
reference cut off stays as it is; a script or style that isn't closed goes to the page's end, other elements end with
what is around them; of elements that hold equally much the deepest and first is taken; null ids and urls and repeated
rows pass through; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.shared import release

# The elements of HTML by what they do to text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object output picture q ruby rt rp s samp small span strike strong sub sup time tt u var"
    " math mfrac mi mn mo mover mrow ms msqrt msub msubsup msup mtext munder semantics".split()
)
#: Void elements that a text runs on around.
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
#: Elements inside a text whose own text isn't shown as such.
UNSEEN = frozenset("audio button canvas datalist meter progress select svg template video".split())
NOT_CONTENT = frozenset("nav header footer aside form head menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {  # an open element of the key is closed by the start of one of these
    "p": frozenset("address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
# Names of what surrounds an article.
NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent"
    " notice alert newsletter subscribe signup popup modal overlay comment comments respond reply replies disqus share sharing social related recommended recommendations"
    " widget toolbar pagination pager login search"
)
MARKED = frozenset(NAMES.split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>]){ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>{ATTRIBUTES})(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content is no markup, if they are closed, and their ends.
PLAIN_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("noscript", "textarea", "iframe", "title")}
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
#: Weights of a block's neighbours in the smoothing.
KERNEL = np.array([0.06, 0.24, 0.40, 0.24, 0.06])
#: The least score of a content path, in standard deviations and as a part of the best path's.
THRESHOLD, LEAST_PART = 0.5, 0.2
#: The part of the text on content paths that the content node holds.
MOST = 0.7
#: What the ratios of paths in an article or main element, and of hinted ones, are multiplied by.
ARTICLE, HINT = 4.0, 0.25


class Block(NamedTuple):
    path: int
    node: int  # the innermost element around it
    text: str
    links: int  # characters in links
    hinted: bool  # an element around it has a name that hints at something else than content


class Page:
    """The blocks of a page, its elements and its tag paths. Elements and paths are numbered as they come, 0 being the
    page, and know what is around them by number, so a page of any depth takes as much room as it has elements."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.depth, self.path_of = [0], [0], [0]
        self.names, self.in_article = [""], [False]
        self._paths: dict[tuple[int, str], int] = {}

    def open(self, parent: int, name: str) -> int:
        """A new element's number."""
        around = self.path_of[parent]
        path = self._paths.setdefault((around, name), len(self.names))
        if path == len(self.names):
            self.names.append(name)
            self.in_article.append(self.in_article[around] or name.split(".")[0] in ("article", "main"))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.path_of.append(path)
        return len(self.parent) - 1

    def name(self, node: int) -> str:
        return self.names[self.path_of[node]].split(".")[0]

    def weight(self, b: Block) -> float:
        return (ARTICLE if self.in_article[b.path] else 1.0) * (HINT if b.hinted else 1.0)

    def gathered(self, own: list[float]) -> list[float]:
        """Sums over everything in an element, of what elements have themselves; an element comes after what is around it."""
        out = list(own)
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def inside(self, node: int) -> list[bool]:
        """Which elements are the given one or in it."""
        out = [not node] * len(self.parent)
        for n in range(1, len(out)):
            out[n] = n == node or out[self.parent[n]]
        return out


def _judged(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's name in a path, whether it is no content, and whether its class or id hints at that."""
    if not attributes.strip(" /"):
        return tag, tag in NOT_CONTENT, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes, ids = (found.get(c, "").lower().split() for c in ("class", "id"))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    named = tag not in HEADINGS and tag not in ("body", "html", "article", "main")
    outright = named and any(MARKED.issuperset(re.split("[-_]", t)) for t in (*classes, *ids))
    hinted = named and any(not MARKED.isdisjoint(re.split("[-_]", t)) for t in classes)
    label = re.sub(r"\d+", "", (classes or ids or [""])[0])
    return f"{tag}.{label}" if label else tag, bool(tag in NOT_CONTENT or found.get("role", "").lower() in ROLES or hidden or outright), hinted


def read(page: str) -> Page:
    """A page with every block that isn't marked, in page order."""
    out = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, no content and hinted (itself or around it)
    still_open: dict[str, int] = defaultdict(int)
    never_closed: set[str] = set()  # elements of plain text of which no end follows
    text: list[str] = []
    links, in_link, at = 0, False, 0
    unseen: list[str] = []  # an inline element that isn't shown, and those of its kind inside it

    def say(piece: str) -> None:
        nonlocal links
        text.append(piece)
        links += len(piece) if in_link else 0

    def flush() -> None:
        nonlocal links
        if text:
            words = entities.unescape("".join(text)).split()
            if words and not (stack and stack[-1][2]):
                node = stack[-1][1] if stack else 0
                out.blocks.append(Block(out.path_of[node], node, " ".join(words), links, bool(stack and stack[-1][3])))
            text.clear()
        links = 0

    def close(count: int) -> None:
        for x in stack[count:]:
            still_open[x[0]] -= 1
        del stack[count:]

    while m := TOKEN.search(page, at):
        if m.start() > at and not unseen:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in VOID:
            continue
        ends, empty = bool(m["end"]), m["attr"].endswith("/")
        if tag in PLAIN_ENDS and not ends and tag not in never_closed:
            if end := PLAIN_ENDS[tag].search(page, at):
                at = end.end()
                continue
            never_closed.add(tag)
        if unseen and tag == unseen[0]:
            if ends:
                unseen.pop()
            elif not empty:
                unseen.append(tag)
        elif unseen and unseen[0] in UNSEEN and not (ends and still_open[tag]):
            continue  # inside it only its end counts, or the end of what is around it
        elif tag == "br":
            text.append(" ")
        elif tag in UNSEEN:
            if not ends and not empty and not unseen:
                unseen.append(tag)
        elif tag in INLINE:  # a marked inline element hides its own text only
            if unseen:
                continue
            if tag == "a":
                in_link = not ends
            if not ends and m["attr"] and _judged(tag, m["attr"])[1]:
                unseen.append(tag)
        else:
            unseen.clear()
            in_link = False
            flush()
            if ends:
                if still_open[tag]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                continue
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            if tag != "hr":
                name, marked, hinted = _judged(tag, m["attr"])
                _, around, around_marked, around_hinted = stack[-1] if stack else ("", 0, False, False)
                stack.append((tag, out.open(around, name), marked or around_marked, hinted or around_hinted))
                still_open[tag] += 1
    if at < len(page) and not unseen:
        say(page[at:])
    flush()
    return out


def path_scores(page: Page) -> tuple[dict[int, float], float]:
    """The mean of the smoothed and fused ratios of each path, and the deviation of the fused ratios along the page."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in page.blocks:
        length[b.path] += max(0, len(b.text) - b.links)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        count[b.path] += 1
    along = np.array([(length[b.path] / count[b.path], (1 + marks[b.path]) / count[b.path]) for b in page.blocks])
    half = len(KERNEL) // 2
    padded = np.pad(along, ((half, half), (0, 0)), mode="edge")
    smooth = np.stack([np.convolve(padded[:, k], KERNEL, mode="valid") for k in (0, 1)], axis=1)
    fused = smooth.prod(axis=1) * np.array([page.weight(b) for b in page.blocks])
    by_path = defaultdict(list)
    for b, score in zip(page.blocks, fused, strict=True):
        by_path[b.path].append(score)
    return {p: float(np.mean(s)) for p, s in by_path.items()}, float(fused.std())


def content_paths(page: Page, threshold: float = THRESHOLD) -> set[int]:
    """Paths whose score reaches the threshold; one at least if there is a block."""
    scores, deviation = path_scores(page)
    most = max(scores.values())
    least = min(most, max(threshold * deviation, LEAST_PART / THRESHOLD * threshold * most))
    return {p for p, s in scores.items() if s >= least}


def content_node(page: Page, paths: set[int]) -> tuple[int, int]:
    """The number of the content node, the deepest that holds most of the text on content paths, and of what is taken
    with it: the outermost article or main element around it, or what is around a node that is a block itself."""
    own, count = [0.0] * len(page.parent), [0] * len(page.parent)
    for b in page.blocks:
        count[b.node] += 1
        if b.path in paths:
            own[b.node] += len(b.text) * page.weight(b)
    held, blocks_in = page.gathered(own), page.gathered(count)
    node = max((n for n, h in enumerate(held) if h >= MOST * held[0] and blocks_in[n]), key=lambda n: (page.depth[n], -n))
    taken, n = 0, page.parent[node]
    while n:
        if page.name(n) in ("article", "main"):
            taken = n  # the outermost article holds the innermost's headings too
        n = page.parent[n]
    if taken:
        return node, taken
    return node, page.parent[node] if count[node] == blocks_in[node] else node


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The main text, blocks joined by newlines; empty if there is none."""
    page = read(html or "")
    if not page.blocks:
        return ""
    paths = content_paths(page, threshold)
    node, taken = content_node(page, paths)
    core, whole = page.inside(node), page.inside(taken)

    def kept(b: Block) -> bool:
        if b.path in paths:
            return True
        # Beside the content node, what isn't on a content path and is links for the most part is a list of other pages.
        beside = not core[b.node] and 2 * b.links > len(b.text) and page.name(b.node) != "h1"
        return not b.hinted and not beside

    return "\n".join(b.text for b in page.blocks if whole[b.node] and kept(b))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )
        release()

    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
