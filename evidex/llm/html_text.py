"""Main text of web pages by tree scoring.

A tolerant reader turns a page into a tree of block elements and runs of text.
Each paragraph passes points for its length and commas to its ancestors, less
with distance and with the share of its text that is links. The container of
most points, discounted by its own link density, is the article; siblings that
look like more of it are kept, boilerplate inside is not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: how elements nest and which have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, looked for up to one of the others.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("table td th caption".split())
TABLES, LISTS = frozenset(["table"]), frozenset("ul ol menu dir".split())
TABLE_PART = frozenset("table tbody thead tfoot tr td th caption".split())
#: How many open elements an end tag is looked for in; one further out is left open, so that no page takes quadratic time.
REACH_OF_END = 512

# What is never the article, by element, by role and by the words of class names and ids.
DROPPED = frozenset(
    "script style title textarea xmp iframe noembed noframes noscript template head button select input datalist svg math canvas object embed applet audio video map".split()
)
DOUBTED = frozenset("aside dialog fieldset footer form menu nav search".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar tooltip".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertise advertisement advertisements advertising adsense adslot adbox adblock sponsor sponsored sponsors promo promos promoted promotion banner "
    "breadcrumb breadcrumbs comment comments commentlist commenting cookie cookies consent copyright discussion disqus disclaimer feedback footer foot footnav gdpr hidden "
    "login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification outbrain overlay paginate pagination pager paywall popover popup print "
    "recommendations recommended related replies reply respond responses reviews rss search share sharing shares shoutbox sidebar sidebars signin signup sitemap skip skyscraper "
    "social sponsorship subscribe subscription taboola tags toolbar topbar trending widget widgets".split()
)
HEADS = frozenset("header head".split())
#: A class name with one of these speaks of the page as a whole ("has-sidebar").
ABOUT_PAGE = frozenset("has have with without no not is open closed enabled disabled allow show".split())
KEPT_TAGS = frozenset("html body main".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "attributes", "dropped", "points", "size", "links", "n_links", "own_links", "head", "doubtful")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str], dropped: bool):
        self.name, self.parent, self.attributes, self.dropped = name, parent, attributes, dropped
        self.children: list[Node | tuple[str, int]] = []  # blocks, and runs of text with their characters of links
        self.points = 0.0
        self.size = self.links = self.n_links = self.own_links = 0
        self.head = self.doubtful = False


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def named_words(attributes: dict[str, str]) -> Iterator[list[str]]:
    """Lower-case words of each class name and of the id."""
    for name in [*attributes.get("class", "").split(), *attributes.get("id", "").split()]:
        yield [w.lower() for w in WORDS.findall(name)]


def is_no_text(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is dropped for what it is."""
    if name in DROPPED:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or HIDING.search(attributes.get("style", "")):
        return True
    return name not in KEPT_TAGS and attributes.get("role", "").lower() in DROPPED_ROLES


def is_boilerplate(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element, by its name, class names or id, says that it is not the article."""
    if name in DOUBTED:
        return True
    if not attributes or name in KEPT_TAGS:
        return False
    for words in named_words(attributes):
        if name == "article" and words != ["comment"] and words != ["comment", "body"]:
            continue
        if not BOILERPLATE.isdisjoint(words) and ABOUT_PAGE.isdisjoint(words):
            return True
    return False


def is_head(name: str, attributes: dict[str, str]) -> bool:
    return name == "header" or any(not HEADS.isdisjoint(words) for words in named_words(attributes))


class Reader:
    """Builds the tree; inline elements are on the stack, but only blocks and what is dropped have nodes."""

    def __init__(self):
        self.root = Node("body", None, {}, False)
        self.stack: list[tuple[str, Node | None]] = [("body", self.root)]
        self.open: dict[str, int] = {}
        self.node = self.root
        self.run: list[str] = []
        self.linked = 0  # characters of the run that are links, white space left out
        self.link: int | None = None  # the stack's height where a link is open

    def flush(self) -> None:
        if self.run and not self.node.dropped:  # what is dropped holds no text, and the run around it goes on
            text = " ".join("".join(self.run).split())
            if text:
                self.node.children.append((text, self.linked * len(text) // (len(text) - text.count(" "))))
            self.run, self.linked = [], 0

    def text(self, source: str) -> None:
        if not self.node.dropped:
            text = html.unescape(source) if "&" in source else source
            self.run.append(text)
            if self.link is not None:
                self.linked += sum(map(len, text.split()))

    def push(self, name: str, attributes: dict[str, str]) -> None:
        node = None
        if not self.node.dropped:
            named = is_boilerplate(name, attributes)
            dropped = is_no_text(name, attributes) or named and name not in BLOCK
            if name in BLOCK:
                self.flush()
            if name in BLOCK or dropped:
                node = Node(name, self.node, attributes, dropped)
                if not dropped:
                    node.head, node.doubtful = is_head(name, attributes), named
                    self.node.children.append(node)
                self.node = node
        self.stack.append((name, node))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> None:
        name, node = self.stack.pop()
        self.open[name] -= 1
        if node is not None:
            self.flush()
            self.node = node.parent
        if self.link is not None and len(self.stack) < self.link:
            self.link = None

    def close(self, names: frozenset[str], until: frozenset[str], inline: bool = False) -> None:
        """Close the innermost open element of these names, and all in it, unless one of `until` (or, for an inline one, a block) lies between."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - REACH_OF_END), -1):
            name, _ = self.stack[k]
            if name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in until or inline and name in BLOCK:
                return

    def start(self, name: str, source: str) -> None:
        attributes = attributes_of(source) if source and not source.isspace() else {}
        if name in ("html", "body", "head"):
            return
        if name == "br":
            self.text("\n")
            return
        if name in CLOSES_P:
            self.close(frozenset(["p"]), SCOPE)
            if name in HEADING and self.stack[-1][0] in HEADING:
                self.pop()
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name == "a":
            self.link = None
        if name in VOID:
            if name in BLOCK:
                self.flush()
            return
        self.push(name, attributes)
        if name == "a" and "href" in attributes:
            self.link = len(self.stack)
            self.node.own_links += 1

    def end(self, name: str) -> None:
        if name == "br":
            self.text("\n")
        elif name in ("html", "body", "head"):
            return
        elif name in HEADING:
            self.close(HEADING, SCOPE)
        elif name in BLOCK:
            self.close(frozenset([name]), TABLES - {name} if name in TABLE_PART else LISTS | SCOPE if name == "li" else SCOPE)
        else:
            self.close(frozenset([name]), frozenset(), inline=name not in DROPPED)


def read(source: str) -> Node:
    """The tree of a page, whatever is malformed or cut off in it."""
    reader = Reader()
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0 or lt + 1 >= size:
            reader.text(source[at:])
            break
        mark = source[lt + 1]
        if mark not in "!?/" and not (mark.isascii() and mark.isalpha()):
            reader.text(source[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            reader.text(source[at:lt])
        if source.startswith("<!--", lt):
            stop = source.find("-->", lt + 2)
            at = size if stop < 0 else stop + 3
            continue
        tag = TAG.match(source, lt)
        if tag is None:
            stop = source.find(">", lt)
            if stop < 0:  # cut off in a tag
                break
            at = stop + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            reader.end(name)
            continue
        reader.start(name, tag[3])
        if name in RAW:
            stop = _raw_end(name).search(source, at)
            at = stop.end() if stop else size
            reader.end(name)
    reader.flush()
    while len(reader.stack) > 1:
        reader.pop()
    reader.flush()
    return reader.root


_ENDS: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _ENDS:
        _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I)
    return _ENDS[name]


CONTAINERS = frozenset("article body center dd details div figure li main section td th blockquote table tbody".split())
#: How many ancestors a paragraph passes points to.
REACH = 6


def in_order(root: Node) -> list[Node]:
    """The nodes of a tree in page order."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def measure(order: list[Node]) -> None:
    """Sum characters and links up the tree."""
    for node in reversed(order):
        node.size = node.links = 0
        node.n_links = node.own_links
        for child in node.children:
            if isinstance(child, Node):
                node.size += child.size
                node.links += child.links
                node.n_links += child.n_links
            else:
                node.size += len(child[0])
                node.links += child[1]


def pruned(root: Node) -> None:
    """Take out what calls itself boilerplate.

    It stays if it holds half of all text and an element that the page names
    its article, or if it is a form around three paragraphs or more: an end tag
    that is missing, or a form around a whole page.
    """
    order = in_order(root)
    if not any(node.doubtful for node in order):
        return
    measure(order)
    holds: set[int] = set()
    paragraphs: dict[int, int] = {}
    for node in reversed(order):
        below = [c for c in node.children if isinstance(c, Node)]
        paragraphs[id(node)] = (node.name == "p") + sum(paragraphs[id(c)] for c in below)
        if is_main(node) and not node.doubtful or node.name == "form" and paragraphs[id(node)] > 2 or any(id(c) in holds for c in below):
            holds.add(id(node))
    for node in order:
        node.children = [
            c for c in node.children if not (isinstance(c, Node) and c.doubtful and not (id(c) in holds and 2 * c.size >= root.size))
        ]


def score(root: Node) -> list[Node]:
    """Sum sizes up the tree and pass the paragraphs' points; gives the nodes in page order."""
    order = in_order(root)
    measure(order)
    for node in order:
        if node.name in HEADING:
            continue
        for child in node.children:
            if isinstance(child, Node):
                continue
            text, linked = child
            points = (1 + text.count(",") + text.count("，") + text.count("、")) * min(1.0, len(text) / 25) + min(len(text) / 100, 3.0)
            points *= 1 - linked / len(text)
            holder, level = (node.parent if node.name in ("p", "pre", "li", "dd", "dt", "figcaption", "summary", "caption") and node.parent else node), 0
            while holder is not None and level < REACH:
                holder.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                holder, level = holder.parent, level + 1
    return order


def density(node: Node) -> float:
    """Share of the text that is links."""
    return node.links / node.size if node.size else 0.0


def is_main(node: Node) -> bool:
    """Whether the page itself names this the article."""
    return node.name in ("article", "main") or node.attributes.get("role") in ("main", "article") or node.attributes.get("itemprop", "").lower() == "articlebody"


def weight(node: Node) -> float:
    found = node.points * (1 - density(node))
    if is_main(node) or any(not MAIN_WORDS.isdisjoint(words) for words in named_words(node.attributes)):
        found *= 1.5
    return found


def best_container(order: list[Node]) -> Node | None:
    """The container of most points; one that the page names, or that gathers several like it, takes the place of its part."""
    best = max((n for n in order if n.name in CONTAINERS and not n.doubtful), key=weight, default=None)
    if best is None or best.size == 0:
        return None
    top, node = best, best.parent
    named = best if is_main(best) else None
    while node is not None and named is None:
        named = node if is_main(node) else None
        node = node.parent
    if named is not None:
        return named
    while top.parent is not None and top.parent.name != "body" and weight(top.parent) > 0.75 * weight(top):
        top = top.parent
    return top


def belongs(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container looks like more of the article."""
    if node.size == 0 or node.head:
        return False
    share = density(node)
    if node.name in HEADING:
        return share < 0.5
    if node.name in ("p", "pre", "blockquote"):
        return share < 0.25 and (node.size > 80 or share == 0)
    same = node.attributes.get("class") and node.attributes.get("class") == best.attributes.get("class")
    return share < 0.25 and weight(node) + (0.2 * weight(best) if same else 0) >= max(4.0, 0.2 * weight(best))


def is_menu(node: Node) -> bool:
    """A block of links and little else."""
    return node.n_links >= 3 and density(node) >= 0.8


def blocks(node: Node, inside: bool = True) -> Iterator[str]:
    """Texts of a kept subtree in page order, without menus and heads that hold no heading."""
    todo: list[Node | tuple[str, int]] = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, tuple):
            yield item[0]
        elif item is node or not (is_menu(item) or item.head and not _titled(item)):
            todo.extend(reversed(item.children))


def _titled(head: Node) -> bool:
    """Whether a head inside the article gives its title."""
    todo = [head]
    while todo:
        node = todo.pop()
        if node.name in HEADING:
            return density(head) < 0.5
        todo.extend(c for c in node.children if isinstance(c, Node))
    return False


def main_text(source: str | None) -> str:
    """The article of one page; its blocks joined by an empty line."""
    if not source:
        return ""
    root = read(source)
    pruned(root)
    best = best_container(score(root))
    if best is None:
        return ""
    if best.parent is None:
        kept = [best]
    else:
        kept = [c for c in best.parent.children if isinstance(c, Node) and (c is best or not is_main(best) and belongs(c, best))]
        if is_main(best):  # a story in several parts
            kept += [c for c in best.parent.children if isinstance(c, Node) and c is not best and c.name == best.name and belongs(c, best)]
            kept.sort(key=best.parent.children.index)
    return "\n\n".join(b for node in kept for b in blocks(node))


def extracted(source: Column) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return run.asNondeterministic()(source)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of each page as text.

    A null or empty page has empty text; repeated rows each get theirs; pages
    of any length are read whole; of containers with equal scores the first in
    page order wins; an empty table gives no rows. Returns page_id, url, text
    and n_chars (code points). Other columns are not read.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col).cast("string")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
