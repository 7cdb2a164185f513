"""A small, forgiving reader of web pages: block elements as nodes, runs of inline text as their content.

Inline elements are transparent.  Scripts, styles, form controls, titles and
comments give no text.  Start tags close what they cannot be inside of
(``p``, ``li``, ``dt``, ``td`` ...), end tags without a start are ignored,
and what is open at the end is closed.  As in browsers, elements deeper than
``MAX_DEPTH`` do not nest further; their text belongs to the innermost element
that does.  Every step moves forward through the page, so a page takes time in
proportion to its length.
"""

from __future__ import annotations

import html
import re

# The element names of the language.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav noscript ol p pre search section summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())  # to the end of the page if not closed
SKIPPED = frozenset("template svg math select button object datalist audio video canvas".split())  # only if closed
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
FENCES = frozenset({"table", "td", "th", "html", "body"})  # an end tag does not reach beyond these
MAX_DEPTH = 512

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW | SKIPPED}
NAMED = ("class", "id", "role", "itemprop", "aria-label", "data-testid")


class Node:
    """A block element: ``runs`` are (place in the page, text, characters inside links)."""

    __slots__ = ("tag", "parent", "depth", "tokens", "hidden", "main", "children", "runs", "at")

    def __init__(self, tag: str, parent: int, depth: int, at: int):
        self.tag, self.parent, self.depth, self.at = tag, parent, depth, at
        self.tokens: tuple[str, ...] = ()
        self.hidden = self.main = False
        self.children = 0
        self.runs: list[tuple[int, str, int]] = []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def words_of(values: dict[str, str]) -> tuple[str, ...]:
    """Words of the naming attributes, cut at case changes and marks."""
    return tuple(w.lower() for name in NAMED if name in values for w in _WORD.findall(values[name][:2000]))


class Reader:
    """Builds the nodes of one page; a node's parent always has the smaller number."""

    def __init__(self, page: str | None):
        self.nodes = [Node("#page", -1, 0, 0)]
        self.stack, self.opened = [0], {}
        self.text: list[tuple[str, bool]] = []
        self.link_depth = 0  # depth of the stack in which a link is open
        self.at = 0
        self.unclosed: set[str] = set()  # skipped elements that are not closed any more
        self._read(page or "")
        self._end_run()
        self._split_mixed()

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self._add(page[at:])
                return
            if lt > at:
                self._add(page[at:lt])
            after = page[lt + 1:lt + 2]
            if after.isascii() and after.isalpha() or after == "/" and page[lt + 2:lt + 3].isascii() and page[lt + 2:lt + 3].isalpha():
                m = _TAG.match(page, lt)
                if not m:  # it never ends: nothing after it is text
                    return
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self._close(tag)
                    continue
                if tag in _END:
                    at = self._after(page, tag, at)
                    continue
                self._open(tag, m[3])
            elif page.startswith("<!--", lt):
                close = page.find("-->", lt + 2)
                at = end if close < 0 else max(close + 3, lt + 5)
            elif after in ("!", "?", "/"):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                self._add("<")
                at = lt + 1

    def _after(self, page: str, tag: str, at: int) -> int:
        """The place after an element whose content is no text."""
        close = None if tag in self.unclosed else _END[tag].search(page, at)
        if close:
            end = page.find(">", close.end())
            return len(page) if end < 0 else end + 1
        self.unclosed.add(tag)
        return len(page) if tag in RAW else at

    def _add(self, text: str) -> None:
        self.text.append((text, self.link_depth > 0))

    def _end_run(self) -> None:
        """What has been read since the last block border becomes a run of the innermost open block."""
        if not self.text:
            return
        parts, self.text = self.text, []
        text = " ".join("".join(html.unescape(t) for t, _ in parts).split())
        if text:
            linked = sum(len(t) for t, link in parts if link)
            self.nodes[self.stack[-1]].runs.append((self.at, text, min(linked, len(text))))
            self.at += 1

    def _open(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._end_run()
            elif tag == "br":
                self._add(" ")
            return
        if tag == "a":
            self.link_depth = len(self.stack)
            return
        if tag not in BLOCK:
            return
        self._end_run()
        if tag in ("html", "body") and self.opened.get(tag):
            return
        if tag in CLOSED_BY:
            self._close_implied(*CLOSED_BY[tag])
        elif self.opened.get("p"):
            self._close_implied({"p"}, FENCES)
        if len(self.stack) >= MAX_DEPTH:
            return
        node = Node(tag, self.stack[-1], len(self.stack), self.at)
        if rest and not rest.isspace():
            values = attributes(rest)
            node.tokens = words_of(values)
            node.hidden = "hidden" in values or values.get("aria-hidden") == "true" or \
                "display:none" in values.get("style", "").replace(" ", "").lower()
            node.main = "data-main" in values
        self.nodes[node.parent].children += 1
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.stack.append(len(self.nodes))
        self.nodes.append(node)

    def _close_implied(self, closed: set, fences: set) -> None:
        """Closes the innermost open element of ``closed`` and all inside it, unless a fence is inside it."""
        if not any(self.opened.get(t) for t in closed):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[k]].tag
            if tag in closed:
                self._pop_to(k)
                return
            if tag in fences:
                return

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
            return
        if tag == "br":
            self._add(" ")
            return
        if tag not in BLOCK:
            return
        self._end_run()
        if tag in ("html", "body") or not self.opened.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.nodes[self.stack[k]].tag
            if own == tag:
                self._pop_to(k)
                return
            if own in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def _pop_to(self, k: int) -> None:
        for i in self.stack[k:]:
            self.opened[self.nodes[i].tag] -= 1
        del self.stack[k:]
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def _split_mixed(self) -> None:
        """Runs beside block children become nodes of their own, as each can be text or not by itself."""
        for i in range(len(self.nodes)):
            node = self.nodes[i]
            if node.children and node.runs:
                for run in node.runs:
                    own = Node("#text", i, node.depth + 1, run[0])
                    own.runs = [run]
                    self.nodes.append(own)
                node.children += len(node.runs)
                node.runs = []


def read_page(page: str | None) -> list[Node]:
    return Reader(page).nodes
