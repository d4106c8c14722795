"""Main-text extraction by composite text density.

The page becomes a tree; scripts, styles, controls and hidden parts are left out of it. Menus,
sidebars, notices, adverts, forms and reader comments are known by tag, role or the words of class
and id, but only as a hint: a part that holds nearly all the page's text is looked into instead of
being cut out. For every node the characters and tags below it, and those inside links, give its
composite text density: characters per tag, times a logarithm of the link-adjusted ratio
(C/LC * T/LT) to the base ln(C*LC/nLC + LCb*C/Cb + e). A node's density sum adds its children's
densities. The maximum-sum node is the anchor; the least density on its path to the body is the
threshold. From the body down, every subtree that reaches the threshold marks its maximum-sum node
as content, and headings that lead up to it; what is thinner is left out. The smallest subtree below the
body that holds all marks is the content, so that thin parts between them (references, short paragraphs) stay.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"']?)")
_BARE = re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html caption td th tr tbody thead tfoot li dd dt".split())
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table div section article aside main body html td th blockquote nav form header footer".split())
_LISTS = frozenset("ul ol dl table select".split())
#: Never text of an article.
_DROP = frozenset("script style noscript template button select option textarea input iframe object embed svg canvas audio video head title noembed noframes".split())
#: Not the article's own text, unless nearly all text lies there.
_HINT = frozenset("nav aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that tell what is not the article.
_BAD = frozenset(
    "ad ads advert adverts advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended widget toolbar pagination pager skip copyright disclaimer".split()
)
_COMMENTS = frozenset("comment comments disqus respond replies".split())
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: These hold no article, however much text is in them.
_NEVER = frozenset("nav aside header footer dialog menu".split())
#: A hinted part has nearly all the text if the plain text outside such parts is under this share of its own; for comments, the second.
OVERRULE = (0.2, 0.02)
#: So many plain characters in sentences make a part of an article prose, whatever it is called.
PROSE = 240


class Node:
    __slots__ = ("tag", "parent", "items", "hint", "drop", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items, self.hint, self.drop = tag, parent, [], 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and not x.drop]


def _judge(node: Node, attrs: str, inside_article: bool) -> None:
    """Sets ``drop`` for what is never text, ``hint`` to 1 for what may not be the article's, 2 for comments."""
    tag = node.tag
    node.drop = tag in _DROP
    if tag in _HINT or tag in ("header", "footer") and not (inside_article and tag == "header"):
        node.hint = 1
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") or name == "class" and tag == "article":
                words = _WORDS.findall(value)
                if not _COMMENTS.isdisjoint(words):
                    node.hint = 2
                elif tag != "article" and not _BAD.isdisjoint(words):
                    node.hint = max(node.hint, 1)
        elif name == "role":
            if value in _ROLES:
                node.hint = max(node.hint, 1)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            node.drop = True


class _Tree:
    """The open elements; by tag, their depths, so that each question takes one step."""

    def __init__(self) -> None:
        self.body = self.node = Node("body", None)
        self.open: dict[str, list[int]] = {}
        self.scopes, self.lists = [0], [0]

    def push(self, tag: str) -> Node:
        child = Node(tag, self.node)
        self.node.items.append(child)
        self.node = child
        self.open.setdefault(tag, []).append(child.depth)
        for known, depths in ((_SCOPE, self.scopes), (_LISTS, self.lists)):
            if tag in known:
                depths.append(child.depth)
        return child

    def pop(self) -> None:
        tag, depth = self.node.tag, self.node.depth
        self.open[tag].pop()
        for depths in (self.scopes, self.lists):
            if depths[-1] == depth:
                depths.pop()
        self.node = self.node.parent

    def close(self, tag: str) -> None:
        while self.node.tag != tag:
            self.pop()
        self.pop()

    def inside(self, tags: tuple[str, ...], above: int = 0) -> str:
        """Which of the tags is open, the deepest, below the depth ``above``."""
        depth, tag = max((self.open[t][-1], t) if self.open.get(t) else (0, "") for t in tags)
        return tag if depth > above else ""


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag ends that is open at ``at``: after its >, those in quoted values not counting."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return -1
        if m[0] == ">":
            return m.end()
        quote = _VALUE.match(page, m.end())
        at = quote.end()
        end = page.find(quote[1], at) if quote[1] and quote[1] not in lost else -1
        if quote[1] and end < 0:
            lost.add(quote[1])  # none further on, so it is not looked for again
        at = end + 1 if end >= 0 else _BARE.match(page, at).end()


def parse(page: str) -> Node:
    """The page as a tree under a body, in one pass."""
    tree, at, lost = _Tree(), 0, set()
    while at < len(page):
        m = _OPEN.search(page, at)
        lt = m.start() if m else len(page)
        if lt > at:
            tree.node.items.append(_html.unescape(page[at:lt]))
        if lt == len(page):
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if "-->" not in lost else -1
            if end < 0:
                lost.add("-->")
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            end = len(page) if end < 0 else end
            tree.node.items.append(page[lt + 9 : end])
            at = end + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        at = _tag_end(page, name.end(), lost)
        if at < 0:
            break
        tag = name[0].lower()
        if closing:
            if tag == "p" and not tree.inside(("p",), tree.scopes[-1]):
                tree.node.items.append(Node("p", tree.node))
            elif tag == "br":
                tree.node.items.append(" ")
            elif tag not in ("body", "html") and tree.inside((tag,), 0 if tag in _SCOPE else tree.scopes[-1]):
                tree.close(tag)
            continue
        if tag in ("html", "body"):
            continue
        attrs = page[name.end() : at - 1].rstrip()
        if tag in _CLOSES_P and tree.inside(("p",), tree.scopes[-1]):
            tree.close("p")
        if tag in _SIBLING:
            while open_tag := tree.inside(_SIBLING[tag], tree.lists[-1]):
                tree.close(open_tag)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in _VOID:
            tree.node.items.append(Node("hr", tree.node) if tag == "hr" else " " if tag == "br" else "")
        elif not attrs.endswith("/") or tag in _BLOCK:
            _judge(tree.push(tag), attrs, bool(tree.inside(("article", "main"))))
    return tree.body


def _walk(root: Node) -> list[Node]:
    """All nodes that aren't dropped, children before parents."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.children()
    return out[::-1]


def _count(nodes: list[Node]) -> None:
    for n in nodes:
        n.clear()
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(" ".join(x.split()))
            elif not x.drop:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags + (x.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars


def _hinted(root: Node) -> list[Node]:
    """The outermost hinted nodes below ``root``."""
    out, todo = [], root.children()
    while todo:
        n = todo.pop()
        if n.hint:
            out.append(n)
        else:
            todo += n.children()
    return out


def _plain(n: Node) -> int:
    return n.chars - n.link_chars


def _own(body: Node) -> int:
    """Plain text of article and main elements, outside hinted parts."""
    total, todo = 0, body.children()
    while todo:
        n = todo.pop()
        if n.hint:
            continue
        if n.tag in ("article", "main"):
            total += _plain(n) - sum(map(_plain, _hinted(n)))
        else:
            todo += n.children()
    return total


def _prose(part: Node) -> bool:
    """Whether the part reads as text of its own: blocks of plain sentences, of PROSE characters together."""
    found, todo = 0, [part]
    while todo:
        n = todo.pop()
        inner = [x for x in n.children() if x.tag in _BLOCK]
        if inner:
            todo += [x for x in inner if not x.hint]
        elif _plain(n) >= PROSE // 4 and _plain(n) > 0.7 * n.chars:
            found += _plain(n)
    return found >= PROSE


def prune(body: Node) -> None:
    """Drops what is hinted at, but for parts that the text overrules: those are looked into.

    A part with nearly all the text is looked into where there is no article or main with text of its own, or inside of one;
    so is a part that is hinted at by words alone, lies in an article or main, and reads as prose.
    """
    _count(_walk(body))
    parts = _hinted(body)
    outside, own = _plain(body) - sum(map(_plain, parts)), _own(body)
    todo = sorted(parts, key=_plain)
    while todo:
        n = todo.pop()
        inside = any(p.tag in ("article", "main") for p in _path(n)[:-1])
        nearly_all = outside < OVERRULE[n.hint - 1] * _plain(n) and (not own or inside and n.hint == 1)
        if n.tag in _NEVER or not (nearly_all or inside and n.hint == 1 and n.tag not in _HINT and _prose(n)):
            n.drop = True
            continue
        inner = _hinted(n)
        outside += _plain(n) - sum(map(_plain, inner))
        todo = sorted(todo + inner, key=_plain)


def measure(body: Node) -> list[Node]:
    nodes = _walk(body)
    _count(nodes)
    whole_c, whole_lc = max(1, body.chars), body.link_chars
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        if c:
            plain = max(1, c - n.link_chars)
            base = math.log(c / plain * lc + whole_lc / whole_c * c + math.e)
            n.density = c / t * max(0.0, math.log(c / lc * (t / lt))) / max(1e-9, math.log(base)) if base > 1 + 1e-9 else c / t * max(0.0, math.log(c / lc * (t / lt)))
        n.total = sum(x.density for x in n.children()) or n.density * 1e-3
    return nodes


def _path(n: Node) -> list[Node]:
    out = []
    while n is not None:
        out.append(n)
        n = n.parent
    return out[::-1]


def content(body: Node) -> list[Node]:
    """The roots of the main text, in page order."""
    nodes = measure(body)
    best = max(reversed(nodes), key=lambda n: n.total)
    top = {}
    for n in nodes:  # the maximum-sum node in each subtree
        top[id(n)] = max([n, *(top[id(x)] for x in n.children())], key=lambda k: k.total)
    path = _path(best)
    if best is body:
        return _thick(body)
    threshold = min(n.density for n in path[1:])
    marks, todo = [], [body]
    while todo:
        n = todo.pop()
        if n is not body and n.density >= threshold and n.density:
            marks.append(top[id(n)])
        else:
            todo += reversed(n.children())
    root = _path(marks[0])
    for m in marks:
        if m.tag not in ("h1", "h2"):
            other = _path(m)
            root = [p for p, q in zip(root if root[-1].tag not in ("h1", "h2") else other, other, strict=False) if p is q]
    if len(root) > 1:
        return _headings(body, nodes, [root[-1]])
    return _headings(body, nodes, marks)


def _headings(body: Node, nodes: list[Node], roots: list[Node]) -> list[Node]:
    """The roots, with the title that stands before the first of them, outside it, if it is the page's only h1."""
    titles = [n for n in nodes if n.tag == "h1" and n.chars]
    if len(titles) == 1 and not any(r in _path(titles[0]) or titles[0] in _path(r) for r in roots):
        order = {id(n): k for k, n in enumerate(_order(body))}
        if order[id(titles[0])] < order[id(roots[0])]:
            return [titles[0], *roots]
    return roots


def _order(body: Node) -> list[Node]:
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.children())
    return out


def _thick(body: Node) -> list[Node]:
    """Where the body itself has the maximum sum, its parts but for thin boxes and lists of links alone."""
    out = Node("body", None)
    for x in body.items:
        box = isinstance(x, Node) and x.tag in ("div", "section", "ul", "ol", "dl", "table", "center")
        if not (box and (x.drop or x.density < body.density and (x.tag in ("div", "section", "center") or _is_menu(x)))):
            out.items.append(x)
    return [out]


def _is_menu(n: Node) -> bool:
    return n.link_tags >= 2 and n.link_chars > 0.8 * n.chars


def blocks(root: Node) -> list[str]:
    """The text by blocks, in page order."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        else:
            if x.tag in _BLOCK:
                flush()
                if not x.drop:
                    todo.append(None)
            if not x.drop:
                todo += reversed(x.items)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page)
    prune(body)
    return "\n".join(line for root in content(body) for line in blocks(root))


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page's main text: page_id, url, text, n_chars (code points).

    The text's blocks are joined by one \\n; in a block, runs of white space are one space. A null
    or empty page, or one without text, gives an empty text. Unclosed and misnested tags are read
    as browsers do in the common cases. Rows are taken one by one; other columns are not looked at.
    """
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
