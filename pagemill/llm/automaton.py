"""Removing repeated passages of words with suffix automata of reference shards.

Each chunk of documents gets the passages that it shares with earlier chunks, builds their suffix automaton, and streams
its documents through it: the state after each word gives the longest match that ends there (the matching statistic).
Where that reaches the window, the window came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spans import Words, remove_repeats


class Automaton:
    """The suffix automaton of several passages; a match never spans two of them."""

    def __init__(self, passages: Words):
        self.window = passages.window
        self.spans: list[tuple[int, int, int]] = []
        self.length, self.link, self.next = [0], [-1], [{}]
        for values, _, _ in passages.words:
            self._add(values.tolist())

    def _add(self, word_list: list[int]) -> None:
        length, link, follow = self.length, self.link, self.next
        last = 0
        for c in word_list:
            q = follow[last].get(c)
            if q is not None:  # the string read so far is known from an earlier passage
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = cur
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the strings of at most length[p] + 1."""
        length, link, follow = self.length, self.link, self.next
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        follow.append(dict(follow[q]))
        link[q] = copy
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = copy
            p = link[p]
        return copy

    def add(self, doc: int, lo: int, hi: int) -> None:
        """Look at the windows of a document that start from lo to hi."""
        self.spans.append((doc, lo, hi))

    def matches(self, unit: Words):
        """doc, first and last start of runs of windows that the passages hold."""
        w, length, link, follow = self.window, self.length, self.link, self.next
        for doc, lo, hi in self.spans:
            state, size, run = 0, 0, None
            for at, c in enumerate(unit.values(doc, lo, hi + w).tolist(), lo - w + 1):
                nxt = follow[state].get(c)
                while nxt is None and state:
                    state = link[state]
                    size = length[state]
                    nxt = follow[state].get(c)
                if nxt is None:
                    size = 0
                else:
                    state, size = nxt, size + 1
                    if size > w:  # only the last w words count
                        size = w
                        while length[link[state]] >= w:
                            state = link[state]
                if size == w:
                    if run is None:
                        run = at
                elif run is not None:
                    yield doc, run, at - 1
                    run = None
            if run is not None:
                yield doc, run, hi


def dedup_passages(docs: DataFrame, texts_too: bool = True, **options) -> DataFrame:
    """See spans.remove_repeats; symbols are words ``[^\\x20\\x09-\\x0D]+``, windows are 20 of them."""
    return remove_repeats(docs, Words, Automaton, texts_too, **options)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without windows of 20 words that came before."""
    out = dedup_passages(table(spark, sf_dir, "documents", "doc_id", "text"), texts_too=False)
    return out.select("doc_id", out.n.alias("n_words"), "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, k, array_to_string(words[k:k + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM d)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + shift AS k FROM again, range(20) AS r(shift)),
kept AS (
  SELECT doc_id, k, word FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k)
), t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
