"""A tolerant HTML reader: elements and texts as flat lists, in page order."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An element that opens closes these before it, up to the nearest of the second set.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_P_SCOPE = ("button", "td", "th", "caption", "object")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Dom:
    """``tags``, ``parents``, ``attributes`` (strings) of elements; ``texts``: (element, text) in order; ``order``: elements (as numbers) and texts."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str]] = []
        #: Events in page order: element number opened (>= 0), closed (~number), or a text's place, as (kind, value).
        self.events: list[tuple[str, int]] = []
        #: Places in the stack of open elements by tag, and of open blocks.
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._read(source)

    def _open(self, stack: list[int], number: int) -> None:
        tag = self.tags[number]
        self._places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            self._blocks.append(len(stack))
        stack.append(number)

    def _close(self, stack: list[int], upto: int) -> None:
        while len(stack) > upto:
            number = stack.pop()
            self.events.append(("close", number))
            if stack:
                self._places[self.tags[number]].pop()
                if self.tags[number] in BLOCK:
                    self._blocks.pop()

    def _last(self, tags) -> int:
        """Place in the stack of the last open element of these tags; 0 where there is none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _text(self, stack: list[int], text: str) -> None:
        if text:
            self.events.append(("text", len(self.texts)))
            self.texts.append((stack[-1], html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        stack, at, tags = [0], 0, self.tags
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(stack, source[at:])
                break
            self._text(stack, source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                at_tag = self._last((tag,))
                # An inline end tag does not reach beyond its block.
                if at_tag and (tag in BLOCK or not self._blocks or self._blocks[-1] < at_tag):
                    self._close(stack, at_tag)
                continue
            if tag in BLOCK and self._last(("p",)) > self._last(_P_SCOPE):
                self._close(stack, self._last(("p",)))
            if tag in _CLOSES:
                shut, scope = _CLOSES[tag]
                after = self._last(scope)
                inside = [self._places[t] for t in shut if self._places.get(t)]
                firsts = [places[k] for places in inside if (k := bisect_right(places, after)) < len(places)]
                if firsts:
                    self._close(stack, min(firsts))
            number = len(tags)
            tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(" ".join((v or "").strip("\"'") if n.lower() in ("class", "id", "role", "data-label") else "" for n, v in _ATTRIBUTE.findall(m[3])) if m[3] else "")
            self.events.append(("open", number))
            if tag in VOID or m[3].endswith("/"):
                self.events.append(("close", number))
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                self._open(stack, number)
                if tag in ("title", "textarea"):
                    self._text(stack, source[at : end.start() if end else len(source)])
                self._close(stack, len(stack) - 1)
                at = end.end() if end else len(source)
            else:
                self._open(stack, number)
        self._close(stack, 0)
