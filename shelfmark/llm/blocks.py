"""HTML to text blocks: a forgiving tag reader that keeps, for every block, its chain of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML and words that sites use in class, id and role.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas title textarea select button head audio video".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend br".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption", "legend", "body", "html"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILER_TAGS = frozenset("nav aside footer form menu dialog header".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent "
    "gdpr notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside widget "
    "widgets related recommended recommendations teaser menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
    "toolbar footer foot copyright legal disclaimer comment comments commentlist reply replies respond disqus discussion social share "
    "sharing shares form search login pagination pager skip complementary contentinfo hidden".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STATES = re.compile(r"\b(?:has|is|no|with|without)[-_][A-Za-z]+")  # they tell what the page has elsewhere, not what this element is


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    words: frozenset
    holds_main: bool = False


@dataclass
class Block:
    text: str
    element: int
    linked: int
    chain: list = field(default_factory=list)


def _words(attributes: str) -> frozenset:
    found = [x.lower() for groups in NAMES.findall(attributes) for value in groups for x in WORD.findall(STATES.sub("", value))]
    if HIDDEN.search(attributes):
        found.append("hidden")
    return frozenset(found)


def parse(source: str) -> tuple[list[Element], list[Block]]:
    """Elements (0 is the root) and blocks in page order; white space inside a block is one space."""
    elements, blocks, stack = [Element("#root", -1, 0, frozenset())], [], [0]
    pieces: list[str] = []
    linked = skipped = at = links = 0

    def flush():
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append(Block(text, stack[-1] if elements[stack[-1]].tag in BLOCKS or len(stack) == 1 else _block_of(elements, stack), linked))
        pieces, linked = [], 0

    def text_until(end: int):
        nonlocal linked
        if end > at and not skipped:
            piece = html.unescape(source[at:end])
            pieces.append(piece)
            if links:
                linked += len(piece)

    position = 0
    while True:
        found = TOKEN.search(source, position)
        if found is None:
            break
        text_until(found.start())
        at = position = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["close"]:
            open_at = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), 0)
            if tag in BLOCKS:
                flush()
            if open_at and (tag in BLOCKS or tag in SKIPPED or all(elements[stack[k]].tag not in BLOCKS for k in range(open_at, len(stack)))):
                for k in stack[open_at:]:
                    skipped -= elements[k].tag in SKIPPED
                    links -= elements[k].tag == "a"
                del stack[open_at:]
            continue
        if tag in BLOCKS or tag in SKIPPED and tag not in ("button", "select"):
            flush()
        closes = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                own = elements[stack[k]].tag
                if own in closes:
                    for x in stack[k:]:
                        skipped -= elements[x].tag in SKIPPED
                        links -= elements[x].tag == "a"
                    del stack[k:]
                    break
                if own in BLOCKS and own != "p":
                    break
        if tag in VOID:
            continue
        words = _words(found["attributes"]) if found["attributes"] else frozenset()
        elements.append(Element(tag, stack[-1], len(stack), words))
        if found["attributes"].endswith("/") and tag not in BLOCKS:
            continue
        stack.append(len(elements) - 1)
        skipped += tag in SKIPPED
        links += tag == "a"
        if tag in ("article", "main") and not any(elements[k].words & COMMENT_WORDS for k in stack):
            for k in stack:
                elements[k].holds_main = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, position)
            at = position = end.start() if end else len(source)
    text_until(len(source))
    flush()
    for block in blocks:
        k = block.element
        while k > 0:
            block.chain.append(k)
            k = elements[k].parent
    return elements, blocks


def _block_of(elements: list[Element], stack: list[int]) -> int:
    return next((k for k in reversed(stack) if elements[k].tag in BLOCKS), stack[0])


def boiler_elements(elements: list[Element]) -> list[bool]:
    """By tag, class, id and role; words do not count on what holds the article, and a header inside the article is its own."""
    inside, out = [], []
    for element in elements:
        within = element.parent >= 0 and inside[element.parent]
        inside.append(within or element.tag in ("article", "main"))
        signs = (element.words & BOILER_WORDS) | ({element.tag} & BOILER_TAGS)
        if element.tag in ("html", "body"):
            out.append(False)
        elif element.words & COMMENT_WORDS:
            out.append(True)
        else:
            out.append(not element.holds_main and bool(signs - {"header"} if within else signs))
    return out
