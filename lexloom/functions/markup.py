"""A small tokenizer for one HTML page: element spans, text, and the few facts the page jobs ask for.

It knows the recovery rules that matter to those facts: elements closed by a following one (p, li, tr, td, headings),
the implied tbody, void and raw-text elements, entities and comments. Content misplaced inside a table is left where
it stands.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

RAW_TEXT = frozenset("script style noscript iframe noembed noframes xmp".split())
DECODED_TEXT = frozenset("title textarea".split())

# Groups: end mark, tag, attributes; then tag, attributes and body of an element that holds only text.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<((?i:{'|'.join(sorted(RAW_TEXT | DECODED_TEXT))}))(?=[\s/>])"
    r"((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>(.*?)(?:</(?i:\1)(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<[!?/][^>]*>",
    re.S,
)
GROUPS = 7
DOCTYPE = re.compile(r"(?:\s|<!--.*?-->)*+<!doctype", re.I | re.S)
# What stands between < and > of a tag that can be told without looking past it: name and plain attributes, comment, doctype.
PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][\w-]*=\"[^\"<>]*\")*\s*/?)")
ALTERNATING = re.compile(r"[^<>]*+(?:<[^<>]*+>[^<>]*+)*+")
NO_ELEMENT = re.compile(r"!--[^<>]*--|!(?i:doctype)\s[^<>]*")
# The common entities, the one that makes a & last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}
KNOWN_TAGS = 4096
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PLAIN_ATTRIBUTE = re.compile(r"\s*([a-zA-Z][\w-]*)=\"([^\"&]*)\"\s*")
ATTRIBUTE_REF = re.compile(r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+);?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
TABLE_PARTS = frozenset("caption colgroup tbody thead tfoot tr td th".split())
SECTIONS = frozenset("tbody thead tfoot".split())
SCOPE = frozenset("table td th caption object marquee applet template".split())
SPECIAL = BLOCKS | SCOPE | TABLE_PARTS | frozenset(["button"])
SKIPPED = frozenset("html head body".split())
PLAIN = frozenset("abbr b bdi bdo cite code data dfn em i kbd label mark q s samp small span strong sub sup u var".split())
TAG, ATTRIBUTES, PARENT, LAST, FIRST_TEXT, LAST_TEXT = range(6)
CELLS = frozenset(["td", "th"])
P_TAG = frozenset(["p"])
# Blocks that end an open paragraph and nothing else.
CLOSERS = BLOCKS - HEADINGS - {"table", "li", "dd", "dt", "hr"}
ITEM_BARRIER = SPECIAL - {"address", "div", "p"}
TABLE_LEVELS = SECTIONS | {"table", "tr"}
P_BARRIER = SCOPE | {"button"}
# What to do about a tag; those between END and START are simply opened where their place allows it.
END, PUSH, CELL, CLOSER, HEADING, ROW, ANCHOR, START, PASS = range(9)
ACTIONS = {tag: action for action, tags in ((PUSH, PLAIN), (CELL, CELLS), (CLOSER, CLOSERS), (HEADING, HEADINGS)) for tag in tags}
ACTIONS |= {"tr": ROW, "a": ANCHOR} | dict.fromkeys(SKIPPED, PASS)


class KnownTags(dict):
    """What a tag is, by what stands between its < and >: action, tag, raw attributes, attributes; None if it can't be told.

    A tag can't be told by itself if quotes, comments or elements that hold only text might reach past its end.
    """

    def __missing__(self, inner: str) -> tuple | None:
        if len(self) >= KNOWN_TAGS:
            self.clear()
        found, plain = None, PLAIN_TAG.fullmatch(inner)
        if plain:
            tag, raw = plain[2].lower(), plain[3]
            if plain[1]:
                found = END, tag, raw, None
            elif tag not in RAW_TEXT and tag not in DECODED_TEXT:
                found = ACTIONS.get(tag, START), tag, raw, read_attributes(raw)
        elif NO_ELEMENT.fullmatch(inner):
            found = PASS, "", "", None
        self[inner] = found
        return found


KNOWN = KnownTags()


def decoded(texts: list[str]) -> list[str]:
    """Texts without carriage returns with their entities; where only the common ones stand, all are told at once."""
    joined = "\r".join(texts)
    if joined.count("&") == sum(map(joined.count, ENTITIES)):
        for entity, sign in ENTITIES.items():
            joined = joined.replace(entity, sign)
        return joined.split("\r")
    return [html.unescape(text) if "&" in text else text for text in texts]


class Page:
    """Elements in document order; an element covers the nodes and the texts, some empty, between its first and last ones."""

    __slots__ = ("nodes", "texts", "by_tag", "open", "open_tags", "quirks", "at")

    def __init__(self, source: str):
        self.nodes: list[list] = []
        self.texts: list[str] = []
        self.by_tag: dict[str, list[int]] = {}
        self.open: list[int] = []
        self.open_tags: list[str] = []
        #: Texts before the place that is read.
        self.at = 0
        if "\r" in source:
            source = source.replace("\r\n", "\n").replace("\r", "\n")
        self.quirks = DOCTYPE.match(source) is None
        if not self._read_plain(source):
            self._read(source)

    # Reading

    def _read_plain(self, source: str) -> bool:
        """Reads a page in which every < starts a tag that can be told by itself; False where one does not."""
        if not ALTERNATING.fullmatch(source):
            return False
        parts = source.replace("<", ">").split(">")
        known = list(map(KNOWN.__getitem__, parts[1::2]))
        if None in known:
            return False
        self.texts = parts[0::2]
        if "&" in source:
            self.texts = decoded(self.texts)
        nodes, by_tag, opened, open_tags = self.nodes, self.by_tag, self.open, self.open_tags
        for at, (action, tag, raw, attributes) in enumerate(known, 1):
            if action == END:
                if open_tags and open_tags[-1] == tag:
                    open_tags.pop()
                    node = nodes[opened.pop()]
                    node[LAST], node[LAST_TEXT] = len(nodes) - 1, at
                elif tag not in SKIPPED:
                    self.at = at
                    self._end(tag)
                continue
            if action == CLOSER:
                if "p" in open_tags:
                    self.at = at
                    self._close_from(self._level(P_TAG, P_BARRIER))
            elif action == HEADING:
                if "p" in open_tags or open_tags and open_tags[-1] in HEADINGS:
                    action = START
            elif action == CELL:
                if not open_tags or open_tags[-1] != "tr":
                    action = START
            elif action == ROW:
                if not open_tags or open_tags[-1] not in SECTIONS:
                    action = START
            elif action == ANCHOR:
                if "a" in open_tags:
                    action = START
            elif action == PASS:
                continue
            if action == START:
                self.at = at
                self._start(tag, raw)
                continue
            node = len(nodes)
            nodes.append([tag, attributes, opened[-1] if opened else -1, node, at, at])
            if tag in by_tag:
                by_tag[tag].append(node)
            else:
                by_tag[tag] = [node]
            opened.append(node)
            open_tags.append(tag)
        self.at = len(self.texts)
        self._close_from(0)
        return True

    def _read(self, source: str) -> None:
        texts, nodes, open_tags, unescape = self.texts, self.nodes, self.open_tags, html.unescape
        pieces = TOKEN.split(source)
        columns = (pieces[at::GROUPS] for at in range(1, GROUPS))
        for text, only_tag, only_raw, body, closing, tag, raw in zip(pieces[0::GROUPS], *columns):
            if text:
                texts.append(unescape(text) if "&" in text else text)
                self.at = len(texts)
            if tag is None:
                if only_tag is not None:
                    self._text_element(only_tag.lower(), only_raw, body)
                continue
            tag = tag.lower()
            if closing:
                if open_tags and open_tags[-1] == tag:
                    open_tags.pop()
                    node = nodes[self.open.pop()]
                    node[LAST], node[LAST_TEXT] = len(nodes) - 1, len(texts)
                elif tag not in SKIPPED:
                    self._end(tag)
            elif tag in PLAIN or (tag in CELLS and open_tags and open_tags[-1] == "tr"):
                self._push(tag, raw)
            elif tag in CLOSERS:
                if "p" in open_tags:
                    self._close_from(self._level(P_TAG, P_BARRIER))
                self._push(tag, raw)
            elif tag not in SKIPPED:
                self._start(tag, raw)
        if pieces[-1]:
            texts.append(unescape(pieces[-1]) if "&" in pieces[-1] else pieces[-1])
            self.at = len(texts)
        self._close_from(0)

    def _text_element(self, tag: str, raw: str, body: str) -> None:
        self._start(tag, raw)
        if body:
            self.texts.append(html.unescape(body) if tag in DECODED_TEXT and "&" in body else body)
            self.at = len(self.texts)
        self._close_from(len(self.open) - 1)

    def _push(self, tag: str, raw: str = "") -> None:
        node, at = len(self.nodes), self.at
        parent = self.open[-1] if self.open else -1
        self.nodes.append([tag, read_attributes(raw), parent, node, at, at])
        if tag in self.by_tag:
            self.by_tag[tag].append(node)
        else:
            self.by_tag[tag] = [node]
        if tag not in VOID:
            self.open.append(node)
            self.open_tags.append(tag)

    def _close_from(self, level: int) -> None:
        if level < 0:
            return
        last, last_text = len(self.nodes) - 1, self.at
        for at in self.open[level:]:
            node = self.nodes[at]
            node[LAST], node[LAST_TEXT] = last, last_text
        del self.open[level:], self.open_tags[level:]

    def _level(self, wanted, barrier) -> int:
        """Level of the nearest open element among the wanted ones, not looking past a barrier; -1 if none."""
        tags = self.open_tags
        for level in range(len(tags) - 1, -1, -1):
            tag = tags[level]
            if tag in wanted:
                return level
            if tag in barrier:
                return -1
        return -1

    def _top(self) -> str:
        return self.open_tags[-1] if self.open_tags else ""

    def _start(self, tag: str, raw: str) -> None:
        if tag in TABLE_PARTS:
            if not self._enter_table_part(tag):
                return
        elif tag == "table" and self._top() in TABLE_LEVELS:
            self._close_from(self._level({"table"}, ()))
        elif tag == "li":
            self._close_from(self._level({"li"}, ITEM_BARRIER))
        elif tag in ("dd", "dt"):
            self._close_from(self._level({"dd", "dt"}, ITEM_BARRIER))
        elif tag == "a" and "a" in self.open_tags:
            self._close_from(self._level({"a"}, SPECIAL))
        if tag in BLOCKS and not (tag == "table" and self.quirks):
            if "p" in self.open_tags:
                self._close_from(self._level({"p"}, P_BARRIER))
            if tag in HEADINGS and self._top() in HEADINGS:
                self._close_from(len(self.open) - 1)
        self._push(tag, raw)

    def _enter_table_part(self, tag: str) -> bool:
        top = self._top()
        if top == "tr" and tag in ("td", "th") or top in SECTIONS and tag == "tr":
            return True
        table = self._level({"table"}, ())
        if table < 0:
            return False
        if tag in ("td", "th"):
            row = self._level({"tr"}, {"table"})
            if row < 0:
                self._enter_table_part("tr")
                self._push("tr")
            else:
                self._close_from(row + 1)
        elif tag == "tr":
            section = self._level(SECTIONS, {"table"})
            self._close_from((section if section >= 0 else table) + 1)
            if section < 0:
                self._push("tbody")
        else:
            self._close_from(table + 1)
        return True

    def _end(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag == "p":
            level = self._level({"p"}, P_BARRIER)
            if level < 0:
                self._push("p")
                level = len(self.open) - 1
        elif tag in HEADINGS:
            level = self._level(HEADINGS, SCOPE)
        elif tag in TABLE_PARTS or tag == "table":
            level = self._level({tag}, {"table"})
        elif tag in BLOCKS:
            level = self._level({tag}, SCOPE)
        else:
            level = self._level({tag}, SPECIAL)
        self._close_from(level)

    # Asking

    def find(self, tag: str, within: int = -1) -> list[int]:
        """Elements with this tag below an element, or in the whole page."""
        found = self.by_tag.get(tag, [])
        if within < 0:
            return found
        return found[bisect_left(found, within + 1) : bisect_left(found, self.nodes[within][LAST] + 1)]

    def first(self, tag: str, within: int = -1) -> int:
        found = self.by_tag.get(tag)
        if not found:
            return -1
        at = bisect_left(found, within + 1) if within >= 0 else 0
        return found[at] if at < len(found) and (within < 0 or found[at] <= self.nodes[within][LAST]) else -1

    def parent(self, node: int) -> int:
        return self.nodes[node][PARENT]

    def attribute(self, node: int, name: str) -> str:
        return self.nodes[node][ATTRIBUTES].get(name, "")

    def children(self, node: int, tag: str) -> list[int]:
        nodes = self.nodes
        return [at for at in self.find(tag, node) if nodes[at][PARENT] == node]

    def having(self, tag: str, name: str, value: str, within: int = -1) -> list[int]:
        nodes = self.nodes
        return [at for at in self.find(tag, within) if nodes[at][ATTRIBUTES].get(name) == value]

    def first_having(self, tag: str, name: str, value: str, within: int = -1) -> int:
        nodes = self.nodes
        for at in self.find(tag, within):
            if nodes[at][ATTRIBUTES].get(name) == value:
                return at
        return -1

    def text(self, node: int) -> str | None:
        """Text of the element and everything in it; None for no element."""
        if node < 0:
            return None
        own = self.nodes[node]
        first, last = own[FIRST_TEXT], own[LAST_TEXT]
        return self.texts[first] if last - first == 1 else "".join(self.texts[first:last])


@lru_cache(maxsize=4096)
def read_attributes(raw: str) -> dict[str, str]:
    plain = PLAIN_ATTRIBUTE.fullmatch(raw)
    if plain:
        return {plain.group(1).lower(): plain.group(2)}
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        value = double or single or bare
        if "&" in value:
            value = ATTRIBUTE_REF.sub(lambda ref: html.unescape(ref.group()), value)
        found.setdefault(name.lower(), value)
    return found
