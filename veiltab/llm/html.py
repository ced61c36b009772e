"""Main text of web pages by tree scoring.

The page becomes a tree (open paragraphs and list items are closed as browsers do; scripts, styles and the like are
skipped as raw text). Elements that are navigation, headers, footers, sidebars, notices, adverts, forms or reader
comments by tag, role or class are cut out first. Every block of running text passes points for its length and its
commas to its ancestors, all to the parent, half to the grandparent and less further up (SHARES); a candidate's score is
discounted by its link density. The best candidate and those of its siblings that score near it or read like prose
are kept, and their blocks are joined in page order by one newline.

Edge cases. A null, empty or text-free page gives the empty text. Whole pages are parsed, whatever their length or
depth (the parser does not recurse). Ties go to the earlier element. Repeated rows each give a row. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names of HTML and the words that pages name their parts with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("nav header footer aside form button select input label fieldset dialog menu head object embed canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|disqus|replies|respond|pagination|pager|widget|toolbar|skip|hidden|copyright|legal|disclaimer)(?=$|[\s_-])")  # fmt: skip
KEEP_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|page)(?=$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body td th main".split())

_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
#: Points of a block: one, one per comma, one per 100 characters up to 3.
LEAST_TEXT, MOST_LENGTH_POINTS = 20, 3
#: A sibling is kept from this share of the best score.
SIBLING = 0.2
#: What a block passes of its points to the element that holds it and to those around that.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15, 1 / 18)
LEAVES = frozenset(("p", "pre", "blockquote", "li", "dd", "dt", "td", "th", *HEADINGS))


class Node:
    """block and scope: the nearest element, itself included, that is a block, or that is a paragraph or ends the search for one."""

    __slots__ = ("block", "cut", "kept", "kids", "links", "name", "parent", "points", "scope", "size")

    def __init__(self, name: str, parent: Node | None, cut: bool):
        self.name, self.parent, self.cut, self.kept = name, parent, cut, False
        self.kids: list = []
        self.points, self.size, self.links = 0.0, 0, 0
        self.block: Node = self if parent is None or name in BLOCK else parent.block
        self.scope: Node = self if parent is None or name == "p" or name in SCOPE else parent.scope


def is_cut(name: str, attrs: str, inside_article: bool) -> bool:
    if name in CUT:
        return not (name == "header" and inside_article)
    if attrs.strip():
        names = []
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return True
            if key in ("class", "id"):
                names.append(value)
        said = " ".join(names)
        return bool(said) and name not in ("html", "body", "article", "main") and bool(CUT_NAMES.search(said)) and not KEEP_NAMES.search(said)
    return False


def tags(page: str) -> Iterator[tuple[str, bool, str] | str]:
    """(name, whether it closes, attributes) of each tag and the text between, in one pass over the page.

    A tag whose quotes do not close ends at the next >, and from then on so do all; without any > the rest is text.
    The contents of raw elements are passed over; one that is never closed is skipped as a tag, scripts and styles to
    the end of the page."""
    at, quoted, endless, ends = 0, True, set(), {}
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield page[at : m.start()]
        at = m.end()
        if m["comment"]:
            at = end + 3 if (end := page.find("-->", at)) >= 0 else len(page)
            continue
        attrs = _ATTRS.match(page, at) if quoted and m["name"] else None
        quoted = quoted and not (m["name"] and attrs is None)
        end = attrs.end() - 1 if attrs else page.find(">", at)
        if end < 0:
            yield page[m.start() :]
            return
        said, at = page[at:end], end + 1
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name not in RAW:
            yield name, bool(m["close"]), said
        elif not m["close"] and not said.endswith("/") and name not in endless:
            found = ends.setdefault(name, re.compile(rf"</{re.escape(name)}\s*>", re.I)).search(page, at)
            if found:
                at = found.end()
            elif name in ("script", "style"):
                return
            else:
                endless.add(name)
    if at < len(page):
        yield page[at:]


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page, and its nodes in page order; kids are nodes and strings (entities decoded)."""
    top = Node("html", None, False)
    here, articles, nodes, opened = top, 0, [top], Counter()

    def leave(node: Node) -> None:
        """Closes all elements up to node, node included."""
        nonlocal here, articles
        while True:
            articles -= here.name in ("article", "main")
            opened[here.name] -= 1
            done, here = here is node, here.parent
            if done:
                return

    for tag in tags(page):
        if isinstance(tag, str):
            here.kids.append(entities.unescape(tag))
            continue
        name, close, attrs = tag
        if close:
            if opened[name] <= 0:
                continue
            node = here
            while node is not top and node.name != name and not (name not in BLOCK and node.name in BLOCK):
                node = node.parent
            if node is not top and node.name == name:
                leave(node)
            continue
        if name in BLOCK and here.scope.name == "p" and here.scope is not top:  # a block ends an open paragraph, with what is open in it
            leave(here.scope)
        if name in CLOSED_BY and any(opened[x] > 0 for x in CLOSED_BY[name]):
            node = here
            while node is not top and node.name not in CLOSED_BY[name] and node.name not in SCOPE - {"td", "th"}:
                node = node.parent
            if node is not top and node.name in CLOSED_BY[name]:
                leave(node)
        node = Node(name, here, here.cut or is_cut(name, attrs, articles > 0))
        here.kids.append(node)
        nodes.append(node)
        if name not in VOID and not attrs.endswith("/"):
            here = node
            opened[name] += 1
            articles += name in ("article", "main")
    return top, nodes


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(the block element, its own text, characters of it in links) in page order, without what is cut."""
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    links = [0]
    owner = [top]

    def flush(node: Node) -> None:
        if said := _SPACES.sub(" ", "".join(text)).strip():
            out.append((owner[0], said, min(links[0], len(said))))
        text.clear()
        links[0] = 0
        owner[0] = node

    stack: list[tuple[Node, int, Node, bool]] = [(top, 0, top, False)]
    while stack:
        node, k, block, linked = stack.pop()
        if k < len(node.kids):
            stack.append((node, k + 1, block, linked))
            kid = node.kids[k]
            if isinstance(kid, str):
                text.append(kid)
                if linked:
                    links[0] += len(_SPACES.sub(" ", kid).strip())
            elif kid.cut:
                if kid.name in BLOCK:
                    flush(block)
            elif kid.name in ("br", "hr"):
                text.append(" ")
            else:
                inner = kid if kid.name in BLOCK else block
                if inner is kid:
                    flush(kid)
                stack.append((kid, 0, inner, linked or kid.name == "a"))
        elif node is block and node.parent is not None:
            flush(node.parent.block)
    flush(top)
    return out


def main_text(page: str | None) -> str:
    """The work grows with the page's length, whatever its depth."""
    top, nodes = parse(page or "")
    found = blocks(top)
    if not found:
        return ""
    candidates: dict[int, Node] = {}
    for node, said, linked in found:
        node.size += len(said)
        node.links += linked
        if len(said) < LEAST_TEXT and node.name != "p":
            continue
        points = (1 + said.count(",") + said.count("，") + min(len(said) / 100, MOST_LENGTH_POINTS)) * (1 - linked / len(said))
        at = node.parent or node if node.name in LEAVES else node
        for share in SHARES:
            at.points += points * share
            candidates.setdefault(id(at), at)
            at = at.parent
            if at is None:
                break
    for node in reversed(nodes[1:]):  # children before parents
        node.parent.size += node.size
        node.parent.links += node.links
    if not candidates:
        return "\n".join(said for _, said, linked in found if linked < 0.5 * len(said))
    score = {k: x.points * (1 - x.links / max(x.size, 1)) * (1.25 if x.name in ("article", "main") else 1) for k, x in candidates.items()}
    best = candidates[max(score, key=score.get)]
    most, at = score[id(best)], best.parent
    while at is not None:  # a section that won by itself belongs to the article around it, if that scores near it
        if at.name in ("article", "main") and score.get(id(at), 0.0) >= SIBLING * most:
            best = at
        at = at.parent
    best.kept = True
    if best.parent is not None and best.name != "body":
        least = max(10.0, SIBLING * score.get(id(best), 0.0))
        for kid in best.parent.kids:
            if isinstance(kid, Node) and kid is not best and not kid.cut:
                dense = kid.links / kid.size if kid.size else 1.0
                prose = kid.name in ("p", *HEADINGS) and dense < 0.25 and kid.size > 0
                kid.kept = score.get(id(kid), 0.0) >= least or prose or kid.size > 140 and dense < 0.1
    out = []
    for node in nodes[1:]:  # parents before children
        node.kept = node.kept or node.parent.kept
    lists = best.name in ("article", "main")  # lists of links in an article are its own
    for node, said, linked in found:
        if node.kept and (lists or not (linked > 0.8 * len(said) and node.name in ("li", "ul", "div"))):
            out.append(said)
    return "\n".join(out)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return common.mapped(rows, of, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
