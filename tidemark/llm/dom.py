"""A small tolerant HTML reader for main-text extraction: elements, text runs, features of both."""

from __future__ import annotations

import html as _html
import re
from math import log1p

#: Fixed values of HTML: elements without content, of raw text, that end an open paragraph, and
#: those that an element of the same kind ends; elements that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset(
    "script style textarea title iframe noembed noframes xmp head template noscript svg math object select option "
    "button canvas audio video datalist map".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SIBLINGS_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)

#: Words in class, id and role that speak for a kind of region; a feature each.
ATTRIBUTE_KINDS = {
    "content": "article content entry main post story body text blog page-content",
    "menu": "nav menu breadcrumb breadcrumbs navbar navigation tabs toolbar pagination pager topbar skip",
    "head": "header head masthead banner logo brand top",
    "foot": "footer foot copyright legal bottom colophon contentinfo",
    "side": "sidebar aside side widget rail related recommended popular trending complementary more",
    "notice": "notice cookie cookies consent alert gdpr privacy warning message popup modal overlay toast disclaimer",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense banner-ad outbrain taboola partner",
    "form": "form login signup subscribe newsletter search register contact input",
    "talk": "comment comments reply replies discussion respond disqus thread reader readers feedback reviews",
    "share": "share social follow facebook twitter tweet like author-box tags meta byline",
}
_KIND_OF = {w: k for k, (_, words) in enumerate(ATTRIBUTE_KINDS.items()) for w in words.split()}
N_KINDS = len(ATTRIBUTE_KINDS)
TAG_KINDS = {
    "article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "fieldset": 5, "p": 6, "blockquote": 6,
    "pre": 6, "h1": 7, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "ul": 9, "ol": 9, "dl": 9, "li": 10, "dd": 10, "dt": 10, "table": 11, "tr": 11,
    "td": 11, "th": 11, "div": 12, "section": 13, "body": 14, "html": 14, "#run": 15, "figure": 16, "figcaption": 16, "address": 3, "dialog": 5,
}
FEATURES = (
    "tag depth n_chars share own_link link_share density elements paragraphs punctuation words_per_sentence digits "
    "position siblings sibling_at sibling_share up_share capital".split()
    + [f"is_{k}" for k in ATTRIBUTE_KINDS] + [f"in_{k}" for k in ATTRIBUTE_KINDS] + ["in_nav_tag", "in_form_tag", "in_article_tag", "hidden"]
)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE_MARKS = re.compile(r"[.!?:;,]")


class Node:
    __slots__ = ("tag", "parent", "children", "kinds", "hidden", "truth", "text", "silent", "start", "chars", "links", "elements", "paragraphs", "marks", "words", "digits", "capitals")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.kinds, self.hidden, self.truth, self.text, self.silent = 0, False, None, None, False
        self.start = self.chars = self.links = self.elements = self.paragraphs = self.marks = self.words = self.digits = self.capitals = 0


def _attributes(node: Node, raw: str, marked: bool) -> None:
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            value = a or b or c
            for word in _WORDS.findall(value):
                kind = _KIND_OF.get(word.lower())
                if kind is not None:
                    node.kinds |= 1 << kind
        elif name == "hidden" or (name == "aria-hidden" and "true" in (a, b, c)) or (name == "style" and "none" in (a or b or c)):
            node.hidden = True
        elif marked and name == "data-truth":
            node.truth = (a or b or c) == "1"


def parse(page: str, marked: bool = False) -> list[Node]:
    """Block elements and text runs in page order; the first is the root.

    A run is text of one block that no other block interrupts; its white space is one space each.
    Elements within a line belong to their block, links among them are measured. Unclosed,
    wrongly nested and cut-off markup is read as far as it goes. ``marked``: a made-up page, whose
    data-truth attributes say what is main; elsewhere that attribute is one like any other.
    """
    root = Node("html", None)
    nodes, stack = [root], [root]
    open_tags: dict[str, int] = {}  # how many of each are on the stack, so that it is searched only for what it has
    pieces: list[str] = []
    linked = in_link = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                run = Node("#run", stack[-1])
                run.text, run.links = text, min(linked, len(text))
                stack[-1].children.append(run)
                nodes.append(run)
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal in_link
        flush()
        in_link = 0
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    while at < n:
        found = _TOKEN.search(page, at)
        end = found.start() if found else n
        if end > at and not stack[-1].silent:
            pieces.append(page[at:end])
            if in_link:
                linked += end - at
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(found[1])
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if open_tags.get(tag) else ():
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag == "html" or tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ENDS_P and open_tags.get("p"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in ("td", "th", "table", "button"):
                    break
        if any(map(open_tags.get, SIBLINGS.get(tag, ()))):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SIBLINGS_WITHIN[tag]:
                    break
                if stack[depth].tag in SIBLINGS[tag]:
                    close_to(depth)
                    break
        flush()
        if tag == "body" and stack[-1].tag == "head":
            close_to(len(stack) - 1)
        node = Node(tag, stack[-1])
        node.silent = tag in SILENT or stack[-1].silent
        if found[3]:
            _attributes(node, found[3], marked)
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            over = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = over.start() if over else n
        if not found[0].endswith("/>"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Counts of every subtree, children before parents."""
    so_far = 0
    for node in nodes:
        node.start = so_far
        if node.text:
            text = node.text
            node.chars = len(text)
            node.words = text.count(" ") + 1
            node.marks = len(_SENTENCE_MARKS.findall(text))
            node.capitals = sum(map(str.isupper, text[::7])) if len(text) > 60 else sum(map(str.isupper, text)) // 4
            node.digits = sum(map(str.isdigit, text[::7]))
            so_far += node.chars
    for node in reversed(nodes):
        up = node.parent
        if up is not None and not node.silent:
            up.chars += node.chars
            up.links += node.links
            up.words += node.words
            up.marks += node.marks
            up.capitals += node.capitals
            up.digits += node.digits
            up.elements += node.elements + (node.tag != "#run")
            up.paragraphs += node.paragraphs + (node.tag == "p" and node.chars > 0)


def features(nodes: list[Node]) -> list[list[float]]:
    """FEATURES of every node that has text below it and isn't silent; the others have none (empty)."""
    total = max(1, nodes[0].chars)
    out: list[list[float]] = []
    above: dict[int, tuple[int, int, int, int, bool]] = {}  # depth, kinds, tag bits, place among siblings
    for node in nodes:
        up = node.parent
        depth, kinds, tags, hidden = (0, 0, 0, False) if up is None else above[id(up)][:4]
        kind = TAG_KINDS.get(node.tag, 17)
        own = node.kinds
        if node.tag == "#run":
            own = up.kinds
        here = tags | (1 if kind in (1, 2, 3, 4) else 0) | (2 if kind == 5 else 0) | (4 if kind == 0 else 0)
        above[id(node)] = (depth + 1, kinds | own, here, hidden or node.hidden)
        if node.silent or not node.chars:
            out.append([])
            continue
        siblings = up.children if up is not None else [node]
        at = siblings.index(node) if len(siblings) < 40 else min(39, next(i for i, x in enumerate(siblings) if x is node or i == 39))
        chars = node.chars
        row = [
            kind, depth, log1p(chars), chars / total, node.links / chars, node.links / max(1, up.links if up else node.links),
            log1p(chars / (node.elements + 1)), log1p(node.elements), log1p(node.paragraphs), 100.0 * node.marks / chars,
            node.words / (node.marks + 1), node.digits / chars, node.start / total, log1p(len(siblings)), at / len(siblings),
            chars / max(1, up.chars if up else chars), (up.chars if up else chars) / total, node.capitals / chars,
        ]
        inside = kinds | own
        row += [float(own >> k & 1) for k in range(N_KINDS)] + [float(inside >> k & 1) for k in range(N_KINDS)]
        row += [float(here & 1), float(here >> 1 & 1), float(here >> 2 & 1), float(hidden or node.hidden)]
        out.append(row)
    return out
