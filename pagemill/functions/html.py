"""HTML to Markdown over intervals: a page is a list of events, and every element the interval between two of them.

Which element holds which follows from their intervals, the next sibling of an element begins where it ends, and Markdown
is written in one pass over events with a stack of open buffers. Nothing recurses, so depth isn't bounded.
"""

from __future__ import annotations

import re
from html import escape
from html.entities import html5
from html.parser import HTMLParser

VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "template"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "body", "html", "form", "dl", "dt", "dd"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`"}
LAYOUT = ("data-bbox", "data-label")
#: The class of functions.text; a non-breaking space, say, is text.
SPACE = " \t\r\n\f\x0b"
_SPACES = re.compile(f"[{SPACE}]+")
#: The ampersand of what may be a reference, and its name if a semicolon follows. ``&amp`` needs none.
_AMPERSAND = re.compile(r"&(?!amp|#[0-9]+;|#[xX][0-9a-fA-F]+;)(?=[a-zA-Z#])([a-zA-Z][a-zA-Z0-9]*;)?")


def closed_references(html: str) -> str:
    """HTML whose references without a semicolon, other than ``&amp``, are escaped, so that they are read as text."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), html)


class Page(HTMLParser):
    """Lists with an entry for each event: ``tag`` (None: text; "": an end), ``attrs`` or text in ``what``, ``end`` (the event
    after the element's last) and ``depth``. Unclosed elements end with the one around them; ends without a start are dropped.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = []
        self.what: list = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self._open: list[int] = []
        self._names: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        self._shut(0)

    def _add(self, tag, what) -> int:
        self.tag.append(tag)
        self.what.append(what)
        self.end.append(len(self.tag))
        self.depth.append(len(self._open))
        return len(self.tag) - 1

    def _shut(self, level: int) -> None:
        """End all open elements from a level on, innermost first."""
        while len(self._open) > level:
            at = self._open.pop()
            self._names[self.tag[at]].pop()
            self._add("", at)
            self.end[at] = len(self.tag)

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._names.setdefault(tag, []).append(len(self._open))
            self._open.append(at)

    def handle_startendtag(self, tag, attrs):
        at = self._add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._add("", at)
            self.end[at] = len(self.tag)

    def handle_endtag(self, tag):
        if levels := self._names.get(tag):
            self._shut(levels[-1])

    def handle_data(self, data):
        self._add(None, data)

    def outermost(self, tag: str) -> list[int]:
        """Elements of that name that no other element holds, in order."""
        found, at = [], 0
        while at < len(self.tag):
            if self.tag[at] == tag:
                found.append(at)
            at = self.end[at]
        return found

    def inside(self, at: int) -> tuple[int, int]:
        """The events between an element's start and end."""
        return at + 1, max(self.end[at] - 1, at + 1)

    def raw(self, start: int, end: int, dropped: frozenset = frozenset()) -> str:
        """The events of an interval as HTML."""
        out = []
        for i in range(start, end):
            tag, what = self.tag[i], self.what[i]
            if i in dropped:
                continue
            if tag is None:
                out.append(escape(what, quote=False))
            elif tag == "":
                out.append(f"</{self.tag[what]}>")
            else:
                head = tag + "".join(f' {k}="{escape(v)}"' for k, v in what.items() if k not in LAYOUT)
                out.append(f"<{head}/>" if tag in VOID else f"<{head}>")
        return "".join(out)

    def markdown(self, start: int, end: int, dropped: frozenset = frozenset()) -> str:
        """The events of an interval as Markdown, before white space is tidied. Blocks are set off by blank lines."""
        # An open element: event, buffer, depth of lists around it, whether white space counts.
        stack: list[tuple] = [(None, [], 0, False)]
        i = start
        while i < end:
            tag, what = self.tag[i], self.what[i]
            at, buffer, lists, pre = stack[-1]
            in_list = at is not None and self.tag[at] in ("ul", "ol")
            if tag == "":
                stack.pop()
                stack[-1][1].append(self._closed(at, buffer, lists, self._listed(stack)))
            elif i in dropped or in_list and tag != "li" or tag in SKIPPED:
                i = self.end[i]
                continue
            elif tag is None:
                buffer.append(what if pre else re.sub(r"([*_])", r"\\\1", _SPACES.sub(" ", what)))
            elif tag == "table":
                buffer.append(f"\n\n{self.raw(i, self.end[i], dropped)}\n\n")
                i = self.end[i]
                continue
            elif tag in VOID:
                buffer.append(f"![{what.get('alt', '')}]({what.get('src', '')})" if tag == "img" else "  \n" if tag == "br" else "\n\n---\n\n" if tag == "hr" else "")
            else:
                stack.append((i, [], lists + (tag in ("ul", "ol")), pre or tag in ("pre", "math")))
            i += 1
        return "".join(stack[0][1])

    def _listed(self, stack: list[tuple]) -> bool:
        """Whether the innermost open element is a list."""
        at = stack[-1][0]
        return at is not None and self.tag[at] in ("ul", "ol")

    def _closed(self, at: int, buffer: list[str], lists: int, in_list: bool) -> str:
        """Markdown of an element from that of what it holds."""
        tag, attrs = self.tag[at], self.what[at]
        if tag in ("ul", "ol"):
            first = int(attrs["start"]) if tag == "ol" and (attrs.get("start") or "").isdigit() else 1
            marks = [f"{first + i}." if tag == "ol" else "-" for i in range(len(buffer))]
            lines = [f"{mark} " + body.replace("\n", "\n" + " " * (len(mark) + 1)) for mark, body in zip(marks, buffer)]
            gap = "\n" if lists > 1 else "\n\n"
            return gap + "\n".join(lines) + gap
        text = "".join(buffer)
        bare = text.strip(SPACE)
        if tag == "li" and in_list:
            return re.sub(r"\n{2,}", "\n", bare)
        if tag == "pre":
            return "\n\n```\n" + text.strip("\n") + "\n```\n\n"
        if tag == "math":
            return "" if not bare else f"\n\n$$\n{bare}\n$$\n\n" if attrs.get("display") == "block" else f" ${bare}$ "
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {re.sub(chr(10) + '+', ' ', bare)}\n\n" if bare else ""
        if tag in MARKS:
            return (" " * (text[0] in SPACE) + MARKS[tag] + bare + MARKS[tag] + " " * (text[-1] in SPACE)) if bare else text
        if tag == "a":
            return f"[{bare}]({attrs['href']})" if bare and attrs.get("href") else text
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {x}".rstrip(SPACE) for x in re.sub(r"\n{3,}", "\n\n", bare).split("\n")) + "\n\n" if bare else ""
        if tag in BLOCKS:
            return f"\n\n{bare}\n\n" if bare else ""
        return text


def tidy(markdown: str) -> str:
    """White space at line ends goes but for hard breaks, indents go but for lists and quotes, and blank lines are single."""
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: m[0] if m[0].startswith("  ") else "\n", markdown)
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", re.sub(r"(?m)^[ \t]+(?=[^ \t\r\n\f\x0b])(?![-\d>])", "", text)).strip(SPACE)
