"""Parsing that SQL expressions can't state (broken JSON, open SVG tags, HTML), as Arrow-batched UDFs over plain functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .html import Page, closed_references, tidy
from .structure import first_value, whole_value

#: Where a response may keep its cells, and a picture its SVG, in order of preference.
CELL_KEYS = ("cells", "layout", "layouts", "layout_info", "elements", "data", "result")
SVG_KEYS = ("svg", "svg_code", "image_svg", "picture_svg", "text", "content", "html", "markdown")

_FENCED = re.compile(r"```(?:json)?\s*\n(?P<body>.*?)(?:\n```|\Z)", re.S | re.I)
_ELEMENT = re.compile(r'\{\s*"bbox"\s*:')
_LONG = 65536


def unfenced(text: str) -> str:
    """As functions.text.strip_outer_code_fence, with Python's white space."""
    rows = text.strip().splitlines()
    closed = len(rows) >= 2 and rows[0].startswith("```") and rows[-1].strip() == "```"
    return "\n".join(rows[1:-1]) if closed else text


def first_json(text: str):
    """The whole text as JSON, or else the first value that begins with a bracket or a brace; None if there is none.

    Values nested deeper than ``structure.DEPTH`` are no JSON. Linear in the text, however many brackets it has.
    """
    text = unfenced(text).strip()
    done, value = whole_value(text)
    return value if done else first_value(text)[1]


def code_content(text: str) -> str:
    """Inside the first fenced block (to the end, if it isn't closed), else everything; stripped."""
    found = _FENCED.search(text)
    return (found["body"] if found else text).strip()


def cut_incomplete(text: str) -> str | None:
    """A list of elements that breaks off, closed before its last element; None where that can't be done."""
    text = text.strip()
    if len(text) <= _LONG and text.endswith("]"):
        return None
    starts = [m.start() for m in _ELEMENT.finditer(text)]
    head = text[: starts[-1]].rstrip() if len(starts) > 1 else ""
    return head[:-1] + "]" if head.endswith(",") else None


def recovered_json(text: str):
    """For responses that may break off: fenced content, then what is complete of it, then the first value in it."""
    text = code_content(text)
    for candidate in (text, cut_incomplete(text) if text else None):
        if candidate:
            done, value = whole_value(candidate)
            if done:
                return value
    return first_json(text) if text else None


def cells_in(value) -> list[dict]:
    """The layout cells of a JSON value, at any depth below the known keys."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if isinstance(value, list):
            if found := [x for x in value if isinstance(x, dict)]:
                return found
        elif isinstance(value, dict):
            if value.keys() & {"category", "bbox", "text"}:
                return [value]
            waiting += reversed([value[key] for key in CELL_KEYS if isinstance(value.get(key), (list, dict))])
    return []


def svg_in(value) -> str | None:
    """The first SVG in a string, or anywhere in lists and objects, depth first."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if isinstance(value, str):
            if found := svg_fragment(value):
                return found
        else:
            waiting += reversed([*value.values()] if isinstance(value, dict) else value if isinstance(value, list) else [])
    return None


def svg_fragment(text: str) -> str | None:
    text = unfenced(text).strip()
    text = text[4:].strip() if text[:4].lower() == "svg:" else text
    if whole := re.search(r"<svg\b[^>]*>.*?</svg>", text, re.S | re.I):
        return whole[0].strip()
    part = re.search(r"<svg\b[^>]*>.*", text, re.S | re.I)
    return closed_svg(part[0]).strip() if part else None


def closed_svg(svg: str) -> str:
    """Closing tags for what is still open, innermost first. Tags with a slash inside aren't seen as opening."""
    names = r"[a-zA-Z][\w:-]*"
    opened = re.findall(rf"<({names})\b[^>/]*>", svg)
    if not opened or opened[0].lower() != "svg":
        return svg
    for name in re.findall(rf"</({names})\s*>", svg):
        same = [i for i, x in enumerate(opened) if x.lower() == name.lower()]
        del opened[same[-1] if same else 0 :]
    return svg + "".join(f"</{x}>" for x in reversed(opened))


def _text(cell: dict) -> str:
    value = cell["text"] if "text" in cell else cell.get("content", "")
    return "" if value is None else str(value)


def _box(value) -> list[float] | None:
    try:
        return [float(x) for x in value] if isinstance(value, (list, tuple)) and len(value) == 4 else None
    except (TypeError, ValueError):
        return None


def normal_cells(text: str | None, truncated: bool) -> str | None:
    """The cells as a JSON array that functions.layout can read with its fixed schema; None if there are none."""
    if text is None:
        return None
    found = cells_in((recovered_json if truncated else first_json)(text))
    rows = []
    for c in found:
        category = str(c.get("category") or "").strip()
        svg = next((s for k in SVG_KEYS if (s := svg_in(c.get(k)))), None) if category == "Picture" else None
        rows.append({"category": category, "bbox": _box(c.get("bbox")), "text": _text(c), "svg": svg})
    return json.dumps(rows) if rows else None


def html_page(html: str | None, headers: bool = False, images: bool = True, unclosed: bool = True) -> tuple[str, bool, bool]:
    """Markdown, is_table and is_diagram of a page in labelled blocks; any page without blocks is taken as a whole.

    Images without a source are kept, with an empty one, in blocks of images only. Where Markdown can't be made of a page, its
    content stays as HTML. References without a semicolon are characters, as in a browser, or else (not ``unclosed``) text but for ``&amp``.
    """
    html = unfenced(html or "").strip()
    if not html:
        return "", False, False
    page = Page(html if unclosed else closed_references(html))
    blocks = page.outermost("div")
    labels = [page.what[b].get("data-label", "").strip() for b in blocks]
    content = [x for x in labels if x and x not in ("Page-Header", "Page-Footer", "Blank-Page")]
    least = max(1, len(content) // 2)
    is_table, is_diagram = content.count("Table") >= least, sum(x in ("Image", "Figure", "Diagram") for x in content) >= least
    if not blocks:
        return _said(page, [(0, len(page.tag), frozenset())], html), is_table, is_diagram
    kept = []
    for block, label in zip(blocks, labels):
        if label == "Blank-Page" or label in ("Page-Header", "Page-Footer") and not headers or label in ("Image", "Figure") and not images:
            continue
        start, end = page.inside(block)
        bare = [i for i in range(start, end) if page.tag[i] == "img" and not page.what[i].get("src")]
        dropped = frozenset() if label in ("Image", "Figure") else frozenset(bare)
        for i in bare:
            page.what[i].setdefault("src", "")
        kept.append((start, end, dropped))
    inner = "\n\n".join(x for k in kept if (x := page.raw(*k).strip()))
    return _said(page, kept, inner), is_table, is_diagram


def _said(page: Page, intervals: list[tuple], instead: str) -> str:
    """Intervals as Markdown between blank lines; what stands for them if none says anything, or if that can't be told."""
    try:
        return "\n\n".join(x for i in intervals if (x := tidy(page.markdown(*i)))) or instead
    except Exception:  # noqa: BLE001 - whatever goes wrong, the page's content isn't lost
        return instead


# Row by row, not in Arrow batches: those hold 10,000 rows whatever their length, a worker of these no more than 100 at once.
recover_cells = F.udf(normal_cells, StringType(), useArrow=False)
recover_svg = F.udf(lambda text: None if text is None else svg_fragment(text), StringType(), useArrow=False)
convert_html = F.udf(html_page, StructType([StructField("markdown", StringType()), StructField("is_table", BooleanType()), StructField("is_diagram", BooleanType())]), useArrow=False)


def bounded_blocks(width: int, height: int, factor: int, least: int | None, most: int | None) -> tuple[int, int]:
    """A size in whole blocks near the aspect ratio and within the bounds, giving up blocks one by one."""
    if width <= 0 or height <= 0:
        return width, height
    area, scale = width * height, 1.0
    if most is not None and area > most:
        scale = (most / area) ** 0.5
    elif least is not None and area < least:
        scale = (least / area) ** 0.5
    w, h = (max(1, round(x * scale / factor)) for x in (width, height))
    aspect = width / height
    while most is not None and w * h * factor**2 > most and (w, h) != (1, 1):
        narrower = w > 1 and (h == 1 or abs((w - 1) / h - aspect) < abs(w / (h - 1) - aspect))
        w, h = (w - 1, h) if narrower else (w, h - 1)
    return w * factor, h * factor
