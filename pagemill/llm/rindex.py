"""Removing repeated byte strings with run-length indexes (r-index: Gagie, Navarro and Prezza, 2018).

Each chunk of documents gets the passages that it shares with earlier chunks, builds their run-compressed
Burrows-Wheeler transform with suffix-array samples at both ends of each run, and streams its documents through it from
right to left. The state is a row of the transform, its place in the passages and the length of the longest match that
begins at the symbol at hand (the matching statistic). A symbol that the row's run holds prolongs the match; any other
leads to the nearest run of that symbol, before or after, whichever shares more with the match so far (Boucher et al.,
PHONI, 2021). Only that comparison looks at the passages themselves. Where the statistic reaches the window, the window
came before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spans import Bytes, remove_repeats

#: Symbols that a comparison looks at a time, symbols that are streamed at a time, and windows of a piece of a span (pieces
#: are streamed side by side).
STEP, MANY, PIECE = 32, 1 << 22, 320


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes whose place is still open are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of the group
    size, step = np.bincount(rank, minlength=n), 7
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        o = np.lexsort((second, rank[open_]))
        own, first, second = open_[o], rank[open_[o]], second[o]
        head = np.concatenate([[True], first[1:] != first[:-1]])
        at = np.arange(len(own)) - np.maximum.accumulate(np.where(head, np.arange(len(own)), 0)) + first
        new = head | np.concatenate([[True], second[1:] != second[:-1]])
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        group = np.cumsum(new) - 1
        open_ = own[np.bincount(group)[group] > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """Passages behind a run-length BWT. Symbols are bytes plus one; zero ends a passage, so no match spans two."""

    def __init__(self, passages: Bytes):
        self.window = passages.window
        end = np.zeros(1, np.uint16)
        text = np.concatenate([x for t in passages.texts for x in (np.frombuffer(t, np.uint8).astype(np.uint16) + 1, end)])
        places = suffix_array(text)
        bwt = text[places - 1]
        self.start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.last = np.concatenate([self.start[1:], [len(text)]]) - 1
        self.symbol = bwt[self.start].astype(np.int64)
        # Rows that begin with a symbol come in the order of the rows that it stands before.
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        self.key = self.symbol[self.by_symbol] * len(self.start) + self.by_symbol
        size = (self.last - self.start + 1)[self.by_symbol]
        self.target = np.empty(len(self.start), np.int64)
        self.target[self.by_symbol] = np.cumsum(size) - size
        self.at_start, self.at_last = places[self.start], places[self.last]
        self.text = np.concatenate([text, np.full(STEP + self.window, 600, np.uint16)])
        self.spans: list[tuple[int, int, int]] = []

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from a and b on are the same; ``most`` or more counts as most."""
        out, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            same = self.text[(a + out)[open_][:, None] + np.arange(STEP)] == self.text[(b + out)[open_][:, None] + np.arange(STEP)]
            run = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            out[open_] += run
            open_ = open_[(run == STEP) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def statistics(self, text: np.ndarray, base: np.ndarray, size: np.ndarray):
        """From right to left in the pieces text[base:base + size], longest first: places, and the matching statistic at
        each (the window at most)."""
        runs = len(self.start)
        row, place, length = np.zeros(len(base), np.int64), np.full(len(base), self.at_start[0]), np.zeros(len(base), np.int64)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -step))  # pieces longer than this
            row, place, length = row[:n], place[:n], length[:n]
            at = base[:n] + size[:n] - 1 - step
            c = text[at].astype(np.int64)
            run = np.searchsorted(self.start, row, side="right") - 1
            place, length = place - 1, length + 1
            other = np.flatnonzero(self.symbol[run] != c)
            if len(other):
                after = np.searchsorted(self.key, c[other] * runs + run[other])
                most, here = length[other] - 1, place[other] + 1
                best, share, found = run[other].copy(), np.full(len(other), -1), np.zeros(len(other), bool)
                for near, sample in ((after - 1, self.at_last), (after, self.at_start)):
                    known = (near >= 0) & (near < runs)
                    near = self.by_symbol[np.clip(near, 0, runs - 1)]
                    known &= self.symbol[near] == c[other]
                    common = np.where(known, self._common(here, sample[near], np.where(known, most, 0)), -1)
                    better = common > share
                    best, share = np.where(better, near, best), np.maximum(common, share)
                    row[other[better]] = (self.last if sample is self.at_last else self.start)[near[better]]
                    place[other[better]] = sample[near[better]] - 1
                    found |= known
                run[other], length[other] = best, share + 1
                lost = other[~found]  # no passage holds the symbol
                row[lost], place[lost], length[lost] = self.start[run[lost]], self.at_start[run[lost]], 0
                held = np.ones(n, bool)
                held[lost] = False
                row = np.where(held, self.target[run] + row - self.start[run], row)
            else:
                row = self.target[run] + row - self.start[run]
            length = np.minimum(length, self.window)
            yield at, length

    def add(self, doc: int, lo: int, hi: int) -> None:
        """Look at the windows of a document that start from lo to hi, in pieces."""
        self.spans += [(doc, a, min(hi, a + PIECE - 1)) for a in range(lo, hi + 1, PIECE)]

    def matches(self, unit: Bytes):
        """doc, first and last start of runs of windows that the passages hold."""
        w, at = self.window, 0
        spans = sorted(self.spans, key=lambda s: s[1] - s[2])  # longest first
        while at < len(spans):
            stop, size = at, 0
            while stop < len(spans) and (stop == at or size < MANY):
                size += spans[stop][2] - spans[stop][1] + w
                stop += 1
            yield from self._stream(unit, spans[at:stop])
            at = stop

    def _stream(self, unit: Bytes, spans):
        w = self.window
        doc, lo, hi = (np.array(x, np.int64) for x in zip(*spans))
        text = np.concatenate([np.frombuffer(unit.texts[d], np.uint8)[a : b + w] for d, a, b in spans]).astype(np.uint16) + 1
        size = hi - lo + w
        base = np.cumsum(size) - size
        hit = np.zeros(len(text) + 1, bool)
        for at, length in self.statistics(text, base, size):
            hit[at] = length >= w
        # The last places of a piece begin no window, so runs of hits never span two pieces.
        edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
        edge = np.concatenate([[0], edge]) if hit[0] else edge
        first, last = edge[::2], edge[1::2] - 1
        who = np.searchsorted(base, first, side="right") - 1
        yield from zip(doc[who].tolist(), (first - base[who] + lo[who]).tolist(), (last - base[who] + lo[who]).tolist())


def dedup_bytes(docs: DataFrame, texts_too: bool = True, **options) -> DataFrame:
    """See spans.remove_repeats; symbols are bytes of UTF-8, windows are 100 of them."""
    return remove_repeats(docs, Bytes, RunIndex, texts_too, **options)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without byte strings of 100 that came before."""
    out = dedup_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), texts_too=False)
    return out.select("doc_id", out.n.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
