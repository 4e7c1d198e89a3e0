"""Main text of a web page by tree scoring.

A tolerant reader builds a tree of the page; paragraphs pass points for their length and commas to their
parent and, by half, to the grandparent and further up; a container's points are discounted by the share of
its text that stands in links and changed by what its name says.  The best container is kept with those
siblings that score well or read like running text, unwanted parts are taken out, and the remaining blocks
are joined in page order.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed and joined
by one blank.  Null, empty and text-less pages give an empty text; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe object embed svg math canvas audio video title textarea select option button".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset head".split())
#: A block element that starts ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "head", "tbody", "thead", "tfoot", "tr", "td", "th"}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|breadcrumbs?|comments?|commentlist|replies|reply|disqus\w*|respond|cookies?|consent|gdpr|notice|notification|alert|modal|popup|overlay|paywall|footer|foot|header|masthead|menu|nav\w*|sidebar|side|rail|related\w*|recommend\w*|share\w*|sharing|social|newsletter|subscri\w*|signup|login|search|tags?|toolbar|widget|pagination|pager|skip|legal|copyright|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
UNWANTED_ROLES = frozenset("navigation complementary banner contentinfo search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "name", "hidden", "points", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, name: str = "", hidden: bool = False):
        self.tag, self.parent, self.kids, self.name, self.hidden = tag, parent, [], name, hidden
        self.points, self.chars, self.linked, self.commas = 0.0, 0, 0, 0


def _attributes(raw: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the element is hidden."""
    if "=" not in raw and "hidden" not in raw:
        return "", False
    name, hidden = "", False
    for key, a, b, c in _ATTR.findall(raw):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            name += f" {value}"
        elif key == "role":
            name += " sidebar" if value.lower().strip() in UNWANTED_ROLES else f" {value}"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return name.strip(), hidden


def parse(html: str) -> Node:
    """A tree of the page; open elements end with their parent, and an unknown end tag is dropped."""
    root = Node("#root", None)
    at, here = 0, root
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            here.kids.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag and not (node.tag in ("table", "td", "th") and tag in INLINE) and not (tag == "p" and node.tag in BLOCK):
                node = node.parent
            if node.tag == tag and node is not root:
                here = node.parent
            elif tag == "br":
                here.kids.append(Node("br", here))
            continue
        if tag in ENDS_P or tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            node = here
            while node is not root and node.tag in INLINE:
                node = node.parent
            if tag in ENDS_P and node.tag == "p":
                here = node.parent  # inline elements that were left open end with their paragraph
                node = here
            for own, stop in ((("li",), ("ul", "ol", "menu", "dir")), (("dd", "dt"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table", "tbody", "thead", "tfoot")), (("option",), ("select",))):
                if tag in own:
                    up = here
                    while up is not root and up.tag not in own and up.tag not in stop:
                        up = up.parent
                    if up.tag in own:
                        here = up.parent
        name, hidden = _attributes(m[3])
        node = Node(tag, here, name, hidden)
        here.kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in INLINE:
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        here = node
    if at < len(html):
        here.kids.append(html[at:])
    return root


def _unwanted(node: Node, inside: bool) -> bool:
    """Whether the node is no part of an article; inside an article, its header and likely names stay."""
    if node.hidden or node.tag in RAW or node.tag in ASIDE:
        return True
    if node.tag == "header":
        return not inside
    if node.name and node.tag not in ("html", "body", "article", "main", "#root"):
        return bool(UNLIKELY.search(node.name)) and not (LIKELY.search(node.name) and not re.search(r"(?:^|[\s_-])(?:comments?|ads?|sidebar|footer|nav)(?:$|[\s_-])", node.name, re.I))
    return False


def _measure(root: Node) -> list[Node]:
    """Set the characters, linked characters, commas and points of all nodes; returns the candidates."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _unwanted(k, inside)]
        order.append(node)
        stack.extend((k, inside) for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                k = k.strip()
                node.chars += len(k)
                node.commas += k.count(",") + k.count("،") + k.count("、")
            else:
                node.chars += k.chars
                node.linked += k.chars if k.tag == "a" else k.linked
                node.commas += k.commas
    found: dict[int, Node] = {}
    for node in order:
        blocks = any(not isinstance(k, str) and k.tag in BLOCK for k in node.kids)
        if not (node.tag in ("p", "pre", "td", "blockquote", "h1", "h2", "h3", "li", "dd") or (node.tag in ("div", "section", "article", "main", "body") and not blocks)) or not node.chars:
            continue
        points = 1 + node.commas + min(node.chars / 100, 3)
        up, share = (node.parent if node.tag not in ("div", "section", "article", "main", "body") else node), 1.0
        level = 0
        while up is not None and up.tag != "#root" and level < 5:
            if up.tag in BLOCK:
                if id(up) not in found:
                    found[id(up)] = up
                    up.points += {"article": 25, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3}.get(up.tag, 0)
                    up.points += 25 * bool(LIKELY.search(up.name)) if up.name else 0
                    up.points -= 5 if up.tag in ("ul", "ol", "dl", "h1", "h2", "h3", "th", "li") else 0
                up.points += points * share
                level += 1
                share = 0.5 if level == 1 else share * 2 / 3
            up = up.parent
    return list(found.values())


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _kept(root: Node) -> list[Node | str]:
    candidates = _measure(root)
    if not candidates:
        return [root]
    scored = [(c.points * (1 - _density(c)), -i, c) for i, c in enumerate(candidates)]
    best_points, _, best = max(scored, key=lambda x: x[:2])
    own = {id(c): s for s, _, c in scored}
    # a paragraph or list item is no container: what it stands in is
    while best.parent is not None and best.parent.tag != "#root" and best.tag in ("p", "li", "pre", "blockquote", "td", "tr", "tbody", "ul", "ol", "dl", "dd", "h1", "h2", "h3", "table"):
        best = best.parent
    up = best.parent
    while up is not None and up.tag in ("article", "main"):  # the article is whole
        best, up = up, up.parent
    up = best.parent
    while up is not None and up.tag not in ("#root", "body", "html"):
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        return [best]
    keep: list[Node | str] = []
    for k in best.parent.kids:
        if k is best:
            keep.append(k)
        elif not isinstance(k, str):
            bonus = 0.2 * best_points if k.name and k.name == best.name else 0
            if own.get(id(k), 0) + bonus >= max(10, 0.2 * best_points):
                keep.append(k)
            elif k.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and k.chars and _density(k) < (0.25 if k.chars >= 80 else 0.01):
                keep.append(k)
    return keep


def blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of blocks in page order, their white space as one blank, trimmed."""
    out: list[str] = []
    inline: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(inline))).strip()
        inline.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            inline.append(x)
        elif x.tag == "br":
            inline.append("\n")
        elif x.tag in BLOCK:
            close()
            stack.append(None)
            stack.extend(reversed(x.kids))
        else:
            stack.extend(reversed(x.kids))
    close()
    return out


def extract(html: str | None) -> str:
    return " ".join(blocks(_kept(parse(html)))) if html else ""


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 64):
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield common.arrow(_ARROW, [batch.column(0), batch.column(1), texts, [len(t) for t in texts]])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    common.prepare(df.sparkSession)
    cols = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return cols.mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE_SQL: dict[str, str] = {}
