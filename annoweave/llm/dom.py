"""Pages as trees of blocks: a forgiving HTML reader for one page at a time.

Inline markup is text; a block is an element that starts a new one. Parts that never hold content by their
tag, role or name are left out with all they hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

# Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul head frameset select button noscript template "
    "svg canvas object video audio math map".split())
#: An opening tag ends an open element of these kinds, up to the given borders.
CLOSES = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot".split()), frozenset({"table"}))),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What never is article text, by tag, by role and by the words of class and id.
NEVER_TAGS = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea dialog menu svg "
    "canvas object video audio math map search title xmp noembed noframes".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                        "menubar toolbar".split())
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo "
    "promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer cookie "
    "cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay "
    "comment comments commentlist reply replies respond disqus discussion share sharing social related "
    "recommended pagination pager masthead widget widgets toolbar banner copyright".split())
#: Such names may also say what else a whole page or its article has.
_WHOLE = frozenset({"html", "body", "article", "main"})
_REMARKS = frozenset({"comment", "comments"})
_TITLED = frozenset("article entry post story content".split())
DEPTH = 256  # elements nested deeper are part of the block at this depth

# Quotes count after an equals sign only, as in HTML; what never ends runs to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_NUMBER = re.compile(r"\d{3,}")
_SPACE = re.compile(r"\s+")


class Block:
    """A block of a page: its tag and names, its parent, and its children and texts in order."""

    __slots__ = ("tag", "label", "parent", "depth", "parts", "never", "named", "linked", "key")

    def __init__(self, tag: str, label: str, parent: Block | None, never: bool, named: bool = False):
        self.tag, self.label, self.parent = tag, label, parent
        self.never = never  # no text is kept of it
        self.named = named  # its names say that it is no article
        self.depth = parent.depth + 1 if parent is not None else 0
        self.parts: list = []  # blocks, and pieces of text
        self.linked = 0  # characters of its own text that are in links
        self.key = 0

    @property
    def blocks(self) -> list[Block]:
        return [part for part in self.parts if isinstance(part, Block)]

    @property
    def whole(self) -> bool:
        return self.tag in _WHOLE

    @property
    def runs(self) -> list[str]:
        """Its own text between its blocks, white space put together; empty runs left out."""
        return [run for run in self.texts() if isinstance(run, str)]

    def texts(self) -> Iterator[str | Block]:
        """Its runs of text and its blocks, in order."""
        run: list[str] = []
        for part in [*self.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            if run:
                text = _SPACE.sub(" ", "".join(run)).strip()
                if text:
                    yield text
                run = []
            if part is not None:
                yield part


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)}


def _never(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element shows nothing, or nothing that can be of an article, by its tag and role."""
    return (tag in NEVER_TAGS or tag == "header" and not inside
            or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            or tag not in _WHOLE and attributes.get("role", "").lower() in NEVER_ROLES)


def _named(tag: str, names: list[str], inside: bool) -> bool:
    """Whether the words of class and id say that an element is no part of an article."""
    if tag in _WHOLE:
        return not _REMARKS.isdisjoint(names)
    top = not inside and "header" in names and _TITLED.isdisjoint(names)
    return top or not NEVER_NAMES.isdisjoint(names)


def _within(block: Block | None) -> bool:
    while block is not None:
        if block.tag in ("article", "main"):
            return True
        block = block.parent
    return False


class _Reader:
    """Builds the tree of one page, tag by tag."""

    def __init__(self):
        self.root = self.here = Block("", "", None, False)
        self.linked = False
        self.spare: list[str] = []  # open elements below ``DEPTH``, which have no block of their own

    def text(self, text: str) -> None:
        if text and not self.here.never:
            self.here.parts.append(text)
            if self.linked:
                self.here.linked += len(text.strip())

    def open(self, name: str, text: str) -> None:
        if name in ("br", "hr"):
            self.text(" ")
        elif name == "a":
            self.linked = True
        if name in VOID or name not in BLOCKS:
            return
        self.end_before(name)
        if self.here.depth >= DEPTH:
            self.spare.append(name)
            self.text(" ")
            return
        attributes = _attributes(text) if text else {}
        own = attributes.get("id", "") + " " + attributes.get("class", "")
        names = [n.lower() for n in _NAME.findall(own)]
        inside = _within(self.here)
        label = " ".join(_NUMBER.sub("#", own).split())  # numbers of posts and the like do not tell nodes apart
        block = Block(name, label, self.here, self.here.never or _never(name, attributes, inside),
                      _named(name, names, inside))
        self.here.parts.append(block)
        if not (text.endswith("/") and name in ("svg", "math")):
            self.here, self.linked = block, False

    def end_before(self, name: str) -> None:
        """End the elements that cannot hold the one that opens."""
        here = self.here
        if here.tag == "p" or here.tag in HEADINGS and name in HEADINGS:
            self.here = here = here.parent
        kinds, borders = CLOSES.get(name, (None, None))
        if kinds:
            while here.parent is not None and here.tag not in borders and here.tag not in kinds:
                here = here.parent
            if here.tag in kinds:
                self.here = here.parent

    def close(self, name: str) -> None:
        if name == "a":
            self.linked = False
        if name not in BLOCKS:
            return
        if self.spare:
            if name in self.spare:
                while self.spare.pop() != name:
                    pass
                self.text(" ")
                return
            self.spare = []
        up = self.here
        while up is not None and up.tag != name:
            up = up.parent
        if up is not None:
            self.here, self.linked = up.parent, False


def parse(source: str) -> Block:
    """The tree of a page. Comments and raw text are dropped; unclosed elements end with their parents."""
    reader, at, size = _Reader(), 0, len(source)
    while at < size:
        token = _TOKEN.search(source, at)
        if token is None:
            reader.text(html.unescape(source[at:]))
            break
        if token.start() > at:
            reader.text(html.unescape(source[at:token.start()]))
        at, name = token.end(), token[2]
        if name is None:
            if token[0] == "<":  # no tag: a character
                reader.text("<")
            continue
        name = name.lower()
        if token[1]:
            reader.close(name)
        elif name in RAW:
            end = _raw_end(name).search(source, at)
            at = end.end() if end else size
        else:
            reader.open(name, token[3])
    return reader.root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I)
