"""HTML to leaf blocks: text between block-level boundaries, with the path of elements above it.

One scanner goes forward over the page and never reads a character twice, but
for a bounded look ahead; open elements are found by their names' positions on
the stack, so a page of any shape costs time in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import insort
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Fixed values of the HTML standard: block-level, void and raw-text elements, and
# which open elements a start tag ends.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes xmp textarea title".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "option": ("option",), "optgroup": ("option", "optgroup")}
CELLS = ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "table")
SCOPES = frozenset("ul ol dl table select body html article section main aside nav footer header form div td th caption blockquote".split())
ENDS_P = BLOCK - frozenset("body head html button caption legend option optgroup select summary tbody td tfoot th thead tr title".split())

#: Elements of a path, counted from the block, that the path tells.
STEPS = 48

_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_NAME = re.compile(r"[^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_KEY = re.compile(r"[^\s/>=][^\s/>=]*+|=[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT = re.compile(r"--!?>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*([^\s\"'>]+)", re.I)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


@lru_cache(maxsize=20_000)
def _names(attrs: str) -> str:
    """Values of class, id and role among attributes without quotes, in lower case."""
    return " ".join(v for _, v in _NAMED.findall(attrs)).lower()


class _Tags:
    """Reads tags of one page. What follows the last ">" holds none."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def read(self, at: int) -> tuple[bool, str, str, bool, int]:
        """(is an end tag, name, names of its class, id and role, closes itself, what follows it) of the tag at "<"."""
        if m := _PLAIN.match(self.html, at):
            attrs = m[3]
            return bool(m[1]), m[2].lower(), _names(attrs) if "=" in attrs else "", attrs.endswith("/") and not re.search(r"=\S*$", attrs), m.end()
        html = self.html
        end = html[at + 1] == "/"
        m = _NAME.match(html, at + 1 + end)
        name, at, names, own = m[0].lower(), m.end(), [], False
        first = at
        while True:
            m = _GAP.match(html, at)
            own, at = m[0].endswith("/"), m.end()
            if at > self.last[">"]:  # a quoted value swallowed the last ">": the tag ends at the first one
                return end, name, " ".join(names).lower(), False, html.index(">", first) + 1
            if html[at] == ">":
                return end, name, " ".join(names).lower(), own, at + 1
            m = _KEY.match(html, at)
            key, at = m[0].lower(), m.end()
            value = ""
            if m := _EQUALS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote and at < self.last[quote]:
                    close = html.index(quote, at + 1)
                    value, at = html[at + 1 : close], close + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            if key in ("class", "id", "role"):
                names += value.split()


def _comment_end(html: str, at: int) -> int:
    """What follows the comment or declaration at "<!", "<?" or "</" without a name; the page's end if nothing ends it."""
    if html.startswith("<!--", at):
        if html.startswith((">", "->"), at + 4):
            return html.index(">", at) + 1
        m = _COMMENT.search(html, at + 4)
        return m.end() if m else len(html)
    end = html.find(">", at)
    return end + 1 if end >= 0 else len(html)


class _Open:
    """The open elements: (name, path with it), and where each name, each block and each scope is open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple | None]] = []
        self.at: dict[str, list[int]] = {"": []}
        self.blocks, self.scopes = [-1], [-1]
        self.path: tuple | None = None

    def push(self, name: str, names: str) -> None:
        place = len(self.stack)
        if name in BLOCK:
            self.blocks.append(place)
            if name in SCOPES:
                self.scopes.append(place)
            self.path = (self.path, name, names)
        elif names:
            self.path = (self.path, name, names)
        self.at.setdefault(name, []).append(place)
        self.stack.append((name, self.path))

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.stack) > place:
            self.at[self.stack.pop()[0]].pop()
        for places in (self.blocks, self.scopes):
            while places[-1] >= place:
                places.pop()
        self.path = self.stack[-1][1] if self.stack else None

    def nearest(self, *names: str) -> int:
        return max((places[-1] for n in names if (places := self.at.get(n))), default=-1)

    def steps(self) -> tuple[tuple[str, str], ...]:
        out, p = [], self.path
        while p is not None and len(out) < STEPS:
            p, name, names = p
            out.append((name, names))
        return tuple(reversed(out))

    def start(self, name: str) -> None:
        """Close what a block's start tag ends."""
        if ends := ENDS.get(name):
            found = self.nearest(*ends)
            if found >= 0 and found >= (self.nearest("table") if name in CELLS else self.scopes[-1]):
                self.cut(found)
        if name in ENDS_P and (found := self.nearest("p")) > self.scopes[-1]:
            self.cut(found)

    def end(self, name: str) -> None:
        """Close the nearest element of a name, unless it is outside the table cell that is open; an inline one closes no block."""
        found = self.nearest(name)
        if found < 0 or (name not in CELLS and found < self.nearest("td", "th", "caption")):
            return
        if name not in BLOCK and self.blocks[-1] > found:
            self.at[name].pop()
            insort(self.at[""], found)
            self.stack[found] = ("", self.stack[found][1])
        else:
            self.cut(found)


def leaf_blocks(html: str) -> list[Block]:
    """The page's blocks in order. Character references are decoded, white space is one space, and empty blocks go.

    The content of raw-text elements is skipped, but for <xmp>, whose text is a block as it stands.
    """
    open_, blocks, tags = _Open(), [], _Tags(html)
    parts: list[str] = []
    linked = 0
    path: tuple[tuple[str, str], ...] = ()

    def take(text: str) -> None:
        nonlocal linked, path
        if not parts:
            path = open_.steps()
        parts.append(text)
        if open_.at.get("a"):
            linked += len(text)

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                blocks.append(Block(text, path, linked))
            parts.clear()
        linked = 0

    at, n, last = 0, len(html), tags.last[">"]
    while at < n:
        mark = html.find("<", at)
        if mark < 0 or mark > last:
            if not html.startswith("<!--", mark) or mark < 0:
                take(html[at:])
            elif mark > at:
                take(html[at:mark])
            break
        if mark > at:
            take(html[at:mark])
        kind = html[mark + 1]
        if kind in "!?":
            at = _comment_end(html, mark)
            continue
        first = html[mark + 2 : mark + 3] if kind == "/" else kind
        if not (first.isascii() and first.isalpha()):
            if kind == "/" and first:
                at = _comment_end(html, mark)
            else:
                take("<")
                at = mark + 1
            continue
        is_end, name, names, own, at = tags.read(mark)
        block = name in BLOCK
        if block:
            close()
        if is_end:
            open_.end(name)
            continue
        if block:
            open_.start(name)
        if name == "br":
            parts.append(" ") if parts else None
        if name in RAW and not own:
            end = _raw_end(name).search(html, at)
            if name == "xmp":
                if text := " ".join(html[at : end.start() if end else n].split()):
                    open_.push(name, names)
                    blocks.append(Block(text, open_.steps(), len(text) if open_.at.get("a") else 0))
                    open_.cut(len(open_.stack) - 1)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else n
        elif name not in VOID and not own:
            open_.push(name, names)
    close()
    return blocks


@lru_cache(maxsize=16)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)
