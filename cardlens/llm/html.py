"""HTML pages as trees of labelled elements with their text blocks.

A forgiving single pass in linear time: a tokenizer finds tags, an element stack
follows the few rules by which HTML closes elements that are left open, and
text is gathered into blocks at the borders of block-level elements.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

#: Comments, declarations, and how a tag starts.
OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: Attributes are taken in one go, without backtracking; a stray quote is a character.
ATTRIBUTES = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+")
UNQUOTED = re.compile(r"[^>\"']+|\"[^\"]*\"|'[^']*'|[\"']")
HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Element names; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
BORDER = frozenset(("table", "article", "body"))
#: Where an svg without its end tag ends: at one of these, as in HTML.
BREAKS = (r"b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|"
          r"span|strong|strike|sub|sup|table|tt|u|ul|var|article|section|main|aside|nav|header|footer")
BREAK = re.compile(rf"<(?:(?:{BREAKS})(?=[\s/>])|/(?:{BREAKS}|html)\s*>)", re.I)
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "search section select summary table tbody td tfoot th thead tr ul".split())
#: An element that opens closes the nearest of these, unless one of the others is nearer.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",)), "body": (("head",), ())}
CLOSES_P = BLOCK - {"html", "head", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}


def label(name: str, attributes: str) -> str:
    """Tag with its class, id and role, the presentation of an element.  Digits
    are dropped, so that numbered elements share a presentation; camelCase is
    written with hyphens."""
    if not attributes:
        return name
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    parts = [name]
    for key, sign in (("class", "."), ("id", "#"), ("role", "@")):
        parts += [sign + re.sub(r"[\d/>]+", "", CAMEL.sub("-", word).lower()) for word in sorted(found.get(key, "").split())]
    return "".join(parts)


def _raw_end(html: str, name: str, at: int) -> tuple[int, int]:
    """Where the end tag of a raw element starts and ends."""
    found = RAW_END[name].search(html, at)
    end = html.find(">", found.end()) if found else -1
    return (found.start(), end + 1) if end >= 0 else (len(html), len(html))


class Tokens:
    """Finds tags from any place on, in time linear in the page.

    A tag without its ``>`` is text.  What was outside quotes when such a tag ran
    to the end of the page is remembered: another tag that starts there runs to
    the end as well."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.dead: list[tuple[list[int], list[int]]] = []  # starts and ends of those stretches, a list a run

    def _open(self, at: int) -> bool:
        if at > self.last:
            return True
        for starts, ends in self.dead:
            k = bisect_right(starts, at) - 1
            if k >= 0 and at <= ends[k]:
                return True
        return False

    def next(self, at: int):
        """``(start, end, closing, name, attributes)`` of the next comment,
        declaration (both without a name) or tag; None if there is none."""
        html = self.html
        while m := OPENING.search(html, at):
            name = m[2]
            at = m.end()
            if name is None:
                return m.start(), at, False, None, ""
            if html.startswith(">", at):
                return m.start(), at + 1, bool(m[1]), name.lower(), ""
            if self._open(at):
                continue
            end = ATTRIBUTES.match(html, at).end()
            if end < len(html):
                return m.start(), end + 1, bool(m[1]), name.lower(), html[at:end]
            free = [t.span() for t in UNQUOTED.finditer(html, at) if t[0][0] not in "\"'"]
            self.dead.append(([a for a, _ in free], [b for _, b in free]))
        return None


def _svg_ends(tokens: Tokens, at: int) -> dict[int, int]:
    """{end of an svg's tag: end of its end tag} from ``at`` on, in one pass; an
    svg that has no end tag is not in it."""
    ends, opened = {}, []
    while found := tokens.next(at):
        _, at, closing, name, attributes = found
        void = attributes.endswith("/")
        if name == "svg" and closing:
            if opened:
                ends[opened.pop()] = at
        elif name == "svg" and not void:
            opened.append(at)
        elif name in RAW and not closing and not (void and opened):
            at = _raw_end(tokens.html, name, at)[1]
    return ends


#: Labels of a path at most; deeper elements count to their ancestor there.
DEPTH = 64


class Page:
    """One pass over a page: ``blocks`` of text in page order, each ``(path,
    place, text)``; ``containers``, ``(path, labels of its children)`` of each
    element with element children; ``links`` (href values of a elements) and
    ``title``.

    A path is the labels from the root down to the block's nearest block-level
    element, of ``DEPTH`` labels at most.  ``step(place, tag, label)`` gives the
    place of a block-level element from its parent's; without it there are no
    labels, paths and containers, and texts alone are wanted.  Open elements are
    found by name, so that deep pages take linear time too."""

    def __init__(self, html: str, step=None):
        self.html, self.step = html, step
        self.blocks: list[tuple[str, str, str]] = []
        self.containers: list[tuple[str, str]] = []
        self.links: list[str] = []
        self.title = ""
        self._stack: list[tuple] = []  # (tag, path, place, depth, labels of children)
        self._open: dict[str, list[int]] = {}  # places in the stack, by tag
        self._borders: list[int] = []  # of table, article and body
        self._not_p: list[int] = []  # of block-level elements that are not p
        self._text: list[str] = []
        self._read()

    def _flush(self) -> None:
        if self._text:
            joined = " ".join(unescape("".join(self._text)).split())
            self._text.clear()
            if joined:
                _, path, place, _, _ = self._stack[-1] if self._stack else ("", "", "other", 0, None)
                self.blocks.append((path, place, joined))

    def _close(self, to: int) -> None:
        while len(self._stack) > to:
            tag, path, _, _, children = self._stack[-1]
            if tag in BLOCK:
                self._flush()
                if tag != "p":
                    self._not_p.pop()
                if tag in BORDER:
                    self._borders.pop()
            self._stack.pop()
            self._open[tag].pop()
            if children:
                self.containers.append((path, " ".join(children)))

    def _last(self, names) -> int:
        return max((at[-1] for name in names if (at := self._open.get(name))), default=-1)

    def _end(self, name: str) -> None:
        """An end tag closes its nearest element, but not across a table, article or body."""
        border = -1 if name in ("html", "body") or not self._borders else self._borders[-1]
        at = self._last((name,))
        if at >= 0 and at >= border:
            self._close(at)
        elif name == "p" and border < 0:
            self._flush()

    def _start(self, name: str, attributes: str) -> None:
        block = name in BLOCK
        if block:
            self._flush()
        if name in CLOSES_P:
            at = self._last("p")
            if at > (self._not_p[-1] if self._not_p else -1):
                self._close(at)
        if name in CLOSES:
            ending, border = CLOSES[name]
            at = self._last(ending)
            if at > self._last(border):
                self._close(at)
        mark = ""
        if self.step:
            mark = label(name, attributes)
            if block and self._stack:
                self._stack[-1][4].append(mark)
        if name in VOID:
            if name in ("br", "hr"):
                self._text.append(" ")
            return
        if attributes.endswith("/") and not block:
            return
        _, path, place, depth, _ = self._stack[-1] if self._stack else ("", "", "other", 0, None)
        if block and self.step:
            place = self.step(place, name, mark)
            if depth < DEPTH:
                path, depth = f"{path}/{mark}" if depth else mark, depth + 1
        if block and name != "p":
            self._not_p.append(len(self._stack))
        if name in BORDER:
            self._borders.append(len(self._stack))
        self._open.setdefault(name, []).append(len(self._stack))
        self._stack.append((name, path, place, depth, []))

    def _read(self) -> None:
        html = self.html
        at, n, svgs, titled = 0, len(html), None, False
        tokens = Tokens(html)
        while at < n:
            found = tokens.next(at)
            if not found:
                self._text.append(html[at:])
                break
            start, end, closing, name, attributes = found
            if start > at:
                self._text.append(html[at:start])
            at = end
            if name is None:
                continue
            if closing:
                self._end(name)
            elif name == "svg":
                if not attributes.endswith("/"):
                    svgs = _svg_ends(tokens, start) if svgs is None else svgs
                    # without an end tag it ends before the first tag that cannot be in it
                    cut = None if at in svgs else BREAK.search(html, at)
                    at = svgs.get(at, cut.start() if cut else n)
            elif name in RAW:
                begin, (end, at) = at, _raw_end(html, name, at)
                if name == "title" and not titled and end < at:  # it has an end tag
                    self.title, titled = " ".join(unescape(html[begin:end]).split()), True
            else:
                if name == "a" and (href := HREF.search(attributes)):
                    self.links.append(unescape(href[1] or href[2] or href[3] or ""))
                self._start(name, attributes)
        self._flush()
        self._close(0)


def parse(html: str):
    """``(blocks, containers)`` with ``(path, text)`` blocks."""
    page = Page(html, lambda place, tag, mark: place)
    return [(path, text) for path, _, text in page.blocks], page.containers


def plain_text(html: str) -> str:
    """All visible text of a page, one block a line."""
    return "\n".join(text for _, _, text in Page(html).blocks)


def title(html: str) -> str:
    return Page(html).title
