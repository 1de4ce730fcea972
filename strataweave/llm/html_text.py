"""Main-text extraction by tree scoring.

A tolerant parser builds the page's tree, in time in proportion to the page whatever its depth. Subtrees that are boilerplate
by tag, role, or class and id words go; where such a word may also name a part of an article, or stands beside words of another subject, place, prose and links decide. Every remaining block with text is a paragraph that passes points, for its
length and its commas, to its ancestors: all to the parent, half to the next, a third to the next,
and so on. A container's points are discounted by the share of its text that is link text. The best
container (widened to the article or main element it stands in) and the siblings that score
like it, or are its headings, paragraphs, tables and lists, are kept, and their blocks are joined in page order.

Defined results: null, empty and text-free pages give an empty text. Unclosed, misnested and
cut-off markup is closed where a browser would close it; text after an unfinished tag is lost with
the tag. White space is what Unicode calls so; a line break inside a block is a space. Very
long or deep pages need time and memory in proportion and no recursion. Of containers that score alike the first in the page is taken. Repeated rows are each extracted, and an empty table gives no rows.
Columns beside page_id, url and html never enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataweave.llm.common import blocks, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset(
    "head script style noscript template title textarea xmp iframe noembed noframes nav header footer aside form button "
    "select option input svg canvas object audio video dialog menu map".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
# An opening tag ends the open element of these names, as far as the nearest of the second.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_SCOPE = frozenset("html body table td th caption button object".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status note".split())
#: Words of a class or id that mark boilerplate.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar "
    "topbar bottombar sidebar sidebars aside "
    "comment comments commentlist respond reply replies disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox toast paywall "
    "newsletter subscribe subscription signup login signin outbrain taboola searchbox hidden".split()
)
#: Words of readers' comments; named by id alone they are boilerplate too.
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Words that say where or how a thing is shown, not what it is about. A class whose words are all of these and of WORDS is boilerplate;
#: with any other word in it ('menu-planning', 'comment-analysis') it may name a part of an article, whose content then decides.
SHOWN = frozenset(
    "site page top bottom left right main global primary secondary user users reader readers mobile desktop sticky inline slot unit label zone placement card "
    "dialog link links button btn icon title wrap wrapper container box bar panel pane region area block blocks list item items row col column group module "
    "component section inner outer content body text header footer head foot heading message msg info count form input field thread author meta avatar date time new "
    "latest more all show open close toggle trigger small large big mini fixed floating full half first last js is has no wp fb google id in on the my our your "
    "native display leaderboard rectangle skyscraper article post story entry widget widgets social share".split()
)
#: Words that may also name a part of an article; its content decides (see `_settle`).
DOUBTFUL = frozenset(
    "header masthead footer foot toc skip rail widget widgets discussion reviews promotion share sharing social follow "
    "related recommended recommendations trending popular search form".split()
)
#: Words that speak for a part of an article.
CONTENT = frozenset("post article entry story content text body work works chapter section paper title headline".split())
PROSE = 80  # characters from which a block is prose
PARTS = frozenset("p table pre blockquote figure ol ul dl".split())  # what stands beside the best container as part of its article
KEPT = frozenset(["html", "body", "article", "main"])
_MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAIL = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "strong", "inside", "doubt", "score", "chars", "linked", "prose")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, strong: bool = False, doubt: int = 0):
        self.tag, self.parent, self.drop, self.strong = tag, parent, drop, strong
        self.inside = strong or parent is not None and parent.inside  # of an article or main element
        self.doubt = doubt  # 1: boilerplate by a doubtful word or an anchor, 2: which stands beside a word of content, 3: by a name with another subject in it
        self.items: list = []
        self.score, self.chars, self.linked, self.prose = 0.0, 0, 0, False


def _node(tag: str, tail: str, parent: Node) -> Node:
    strong, doubt = tag in ("article", "main"), 0
    drop = tag in DROPPED
    if not drop and tail.strip(" />\n\t"):
        found = {}
        for name, *values in _ATTRIBUTE.findall(tail[:-1]):
            found.setdefault(name.lower(), next(filter(None, values), ""))
        role = found.get("role", "").strip().lower()
        style = found.get("style", "").replace(" ", "").lower()
        strong = strong or role in ("main", "article") or found.get("itemprop") == "articleBody"
        classes = [_words_of(c) for c in found.get("class", "").split()]
        id_ = _words_of(found.get("id", ""))
        named = id_.union(*classes)
        drop = role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
        if not drop and named & WORDS and tag not in ("html", "body"):
            part = tag == "section" or any(c <= CONTENT and c for c in classes)  # its id is the anchor of a part
            plain = [c for c in classes if c & WORDS and c <= WORDS | SHOWN]
            own = bool(id_ & WORDS) and id_ <= WORDS | SHOWN
            drop = (bool(plain) or own and not (part and not id_ & READERS)) and not (tag in KEPT and "comment" not in named and "comments" not in named)
            if not drop and tag not in KEPT:
                doubt = 1 if own else 3
        elif not drop and named & DOUBTFUL and tag not in KEPT:
            doubt = 2 if named & CONTENT else 1
    return Node(tag, parent, drop, strong, doubt)


def _words_of(name: str) -> frozenset[str]:
    """The words of a class or an id, numbers left out."""
    return frozenset(w.lower() for w in _PART.findall(name) if not w.isdigit())


class _Open:
    """The open elements: a stack, and the places in it of each tag's elements, so that no search walks it."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def top(self) -> Node:
        return self.stack[-1]

    def cut(self, size: int) -> None:
        while len(self.stack) > max(size, 1):
            self.places[self.stack.pop().tag].pop()

    def close(self, names: frozenset[str], scope: frozenset[str]) -> bool:
        """Close the innermost element of these names, unless one of `scope` stands inside it; whether there was one."""
        inner = lambda tags: max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        place = inner(names)
        if place <= 0 or place <= inner(scope - names):
            return False
        self.cut(place)
        return True


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its nodes in page order; items are strings (character references decoded) and nodes."""
    root = Node("#root", None)
    nodes, open_, at, end = [root], _Open(root), 0, len(html)
    while at < end:
        mark = _MARK.search(html, at)
        stop = mark.start() if mark else end
        if stop > at:
            open_.top().items.append(unescape(html[at:stop]))
        if mark is None:
            break
        if mark[1]:
            close = html.find("-->", mark.end())
            at = end if close < 0 else close + 3
            continue
        if mark[2]:
            close = html.find(">", mark.end())
            at = end if close < 0 else close + 1
            continue
        tail = _TAIL.match(html, mark.end())
        if tail is None:  # unbalanced quotes or the end of the page
            close = html.find(">", mark.end())
            if close < 0:
                break
            rest, at = html[mark.end() : close + 1], close + 1
        else:
            rest, at = tail[0], tail.end()
        tag = mark[4].lower()
        if mark[3]:
            open_.close(frozenset([tag]), frozenset() if tag not in ("p", "li") else frozenset(["table"]))
            continue
        if tag in CLOSES_P:
            open_.close(frozenset(["p"]), P_SCOPE)
        if tag in ENDS:
            while open_.close(*ENDS[tag]):
                pass
        if tag in HEADINGS and open_.top().tag in HEADINGS:
            open_.cut(len(open_.stack) - 1)
        node = _node(tag, rest, open_.top())
        open_.top().items.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(html, at)
            if close is None:
                break
            after = html.find(">", close.start())
            at = end if after < 0 else after + 1
        elif tag not in VOID and not (rest.endswith("/>") and tag not in BLOCK):
            open_.push(node)
    return root, nodes


def _walk(top: Node) -> Iterator[tuple[str, object]]:
    """('open', node), ('text', string) and ('close', node) in page order, without dropped subtrees."""
    stack: list[tuple[Node, Iterator]] = [(top, iter(top.items))]
    yield "open", top
    while stack:
        node, items = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            yield "close", node
        elif isinstance(item, str):
            yield "text", item
        elif not item.drop:
            stack.append((item, iter(item.items)))
            yield "open", item


def text_blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(owner, text, link characters) of each block of a subtree."""
    owners: list[Node] = [top]
    parts: list[str] = []
    in_link = linked = 0

    def flush() -> Iterator[tuple[Node, str, int]]:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            yield owners[-1], text, min(linked, len(text))
        linked = 0

    for kind, x in _walk(top):
        if kind == "text":
            parts.append(x)
            if in_link:
                linked += len(" ".join(x.split()))
            continue
        if x is top:
            continue
        if x.tag == "a":
            in_link += 1 if kind == "open" else -1
        if x.tag == "br" and kind == "open":
            parts.append(" ")
        if x.tag in BLOCK:
            yield from flush()
            if kind == "open":
                owners.append(x)
            else:
                owners.pop()
    yield from flush()


def _inside(node: Node) -> Node:
    """The outermost article or main element that the node stands in, or the node."""
    best, x = node, node
    while x is not None:
        if x.strong:
            best = x
        x = x.parent
    return best


def _measure(root: Node, nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks of the page; every node's characters, link characters and whether it holds prose, summed from the leaves up."""
    for x in nodes:
        x.chars = x.linked = 0
        x.prose = False
    found = list(text_blocks(root))
    for owner, text, linked in found:
        owner.chars += len(text)
        owner.linked += linked
        owner.prose = owner.prose or 4 * linked < len(text) and (len(text) >= PROSE or owner.tag in HEADINGS)
    for x in reversed(nodes):  # children come after their parents
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.prose = x.parent.prose or x.prose
    return found


def _settle(nodes: list[Node]) -> None:
    """Drop the doubtful subtrees, but those that read like a part of an article: inside one, or named with a word of
    content, with a heading or prose, and little of their text in links. Inside an article a name with a word of content
    or of some other subject needs no prose."""
    for x in nodes:
        if x.doubt:
            place = x.inside if x.doubt == 3 else x.doubt == 2 or x.inside
            x.drop = not (place and (x.prose or x.doubt >= 2 and x.inside) and 4 * x.linked < x.chars)


def main_text(html: str) -> str:
    """The page's main text, one line per block."""
    root, nodes = parse(html)
    if any(x.doubt for x in nodes):
        _measure(root, nodes)
        _settle(nodes)
    scored: dict[int, Node] = {}
    for owner, text, _ in _measure(root, nodes):
        points = 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)
        paragraph = owner.tag not in ("div", "section", "article", "main", "body", "html", "#root", "td", "center")
        x = owner.parent if paragraph and owner.parent is not None else owner
        level = 1
        while x is not None and level <= 6:
            if owner.tag not in HEADINGS:
                x.score += points / level
            scored[id(x)] = x
            level += 1
            x = x.parent
    if not scored:
        return ""
    worth = lambda n: (n.score + (25 if n.strong else 0)) * (1 - n.linked / max(n.chars, 1))
    candidates = [n for n in scored.values() if n.tag not in ("#root", "html")] or list(scored.values())
    best = max(candidates, key=worth)
    top = _inside(best)
    kept = [top]
    if top.parent is not None and top.tag != "body":
        kept = []
        for x in top.parent.items:
            if isinstance(x, str) or x.drop:
                continue
            dense = x.linked / max(x.chars, 1)
            alike = x.chars and dense < 0.25 and (worth(x) >= max(10, 0.2 * worth(top)) or x.tag in HEADINGS or x.tag in PARTS)
            if x is top or alike:
                kept.append(x)
    return "\n".join(text for x in kept for _, text, _ in text_blocks(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [main_text(x) if x else "" for x in block.column("html").to_pylist()]
            size = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
