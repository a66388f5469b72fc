"""A structural index of text that may hold JSON: which brackets belong together, found in one pass and without recursion.

Whether a bracket stands inside a string depends on where a value begins, so there are two readings of a text: brackets after
an even number of quotes, and those after an odd one. In each, the depth is a running sum, and a bracket's partner is the
next one at its depth. Only brackets with a partner are tried as values, and what a parser has passed over isn't tried again.
"""

from __future__ import annotations

import json

import numpy as np

#: Values nested deeper than this don't count as JSON; a parser could not take them.
DEPTH = 400
_QUOTE, _SLASH = ord('"'), ord("\\")


def _signs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character the parity of the quotes up to it, and whether it opens or closes a bracket."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(code))
    # A quote is escaped after an odd run of backslashes.
    slash = np.concatenate([[False], code == _SLASH])[: len(code)]
    run = place - np.maximum.accumulate(np.where(slash, 0, place))
    parity = np.cumsum((code == _QUOTE) & (run % 2 == 0)) & 1
    return parity, (code == ord("[")) | (code == ord("{")), (code == ord("]")) | (code == ord("}"))


class Index:
    """start, end, reading and level of every bracket with a partner, by start."""

    def __init__(self, text: str):
        parity, opens, closes = _signs(text)
        found = []
        for reading in (0, 1):
            at = np.flatnonzero((opens | closes) & (parity == reading))
            total = np.cumsum(np.where(opens[at], 1, -1))
            level = np.where(opens[at], total, total + 1)
            # Brackets of one level, in order: an open one belongs to the next if that closes.
            order = np.lexsort((at, level))
            one, two = order[:-1], order[1:]
            pair = opens[at[one]] & closes[at[two]] & (level[one] == level[two])
            found.append(np.stack([at[one[pair]], at[two[pair]] + 1, np.full(pair.sum(), reading), level[one[pair]]]))
        start, end, reading, level = np.concatenate(found, axis=1)
        order = np.argsort(start)
        self.start, self.end, self.reading, self.level = start[order], end[order], reading[order], level[order]

    def heights(self) -> list[int]:
        """Levels of brackets inside each pair, itself included."""
        height, above, last = [1] * len(self.start), [], {}
        for i, (reading, level, end) in enumerate(zip(self.reading.tolist(), self.level.tolist(), self.end.tolist())):
            j = last.get((reading, level - 1))
            above.append(j if j is not None and self.end[j] >= end else None)
            last[reading, level] = i
        for i in range(len(height) - 1, -1, -1):
            if above[i] is not None:
                height[above[i]] = max(height[above[i]], height[i] + 1)
        return height


def first_value(text: str):
    """(True, value) of the first list or object that is whole, in order of where they start; (False, None) if none is.

    A failed attempt tells where it failed: brackets of its reading that close before are values already passed over, and
    those that close later would fail at the same place. So each reading is parsed once.
    """
    if not ("[" in text or "{" in text):
        return False, None
    index, until = Index(text), {0: -1, 1: -1}
    deep = len(index.level) and np.ptp(index.level) >= DEPTH
    heights = index.heights() if deep else [1] * len(index.start)
    for start, end, reading, height in zip(index.start.tolist(), index.end.tolist(), index.reading.tolist(), heights):
        if start < until[reading]:
            if end <= until[reading]:
                return True, json.loads(text[start:end])
        elif height <= DEPTH:
            try:
                return True, json.loads(text[start:end])
            except json.JSONDecodeError as e:
                until[reading] = start + e.pos
    return False, None


def whole_value(text: str):
    """(True, value) if all of the text is one JSON value that isn't too deep."""
    try:
        return (False, None) if _too_deep(text) else (True, json.loads(text))
    except ValueError:
        return False, None


def _too_deep(text: str) -> bool:
    """Whether a parser that begins at the start of the text would enter more than DEPTH levels."""
    if text.count("[") + text.count("{") <= DEPTH:
        return False
    parity, opens, closes = _signs(text)
    step = np.where(parity == 0, opens.astype(np.int64) - closes, 0)
    return int(np.cumsum(step).max(initial=0)) > DEPTH
