"""Finding long repeats over a whole corpus without comparing every shard with every other.

Documents lie in chunks: ranges of doc_id, so "earlier" is a smaller chunk, or an earlier place in the same chunk. A
window of the text (20 words, or 100 bytes) that occurs twice has the same least k-gram at the same place, its anchor;
the windows of one anchor, taken together, are the anchor's context.

1. Each chunk sends the hashes of its different (anchor, context) pairs to buckets. A bucket sees which anchors are in
   several chunks. Where all contexts are alike, each of them gets the context from the last one before it.
2. For anchors with several contexts, the chunks send hashes of the single windows instead, and each chunk gets a window
   from the last one before it.
3. Chunks cut the passages they were asked for, merged where they overlap, and send them to the chunks that need them.
4. Each chunk indexes the passages it was sent (its reference shard) and those it repeats itself, and streams its
   documents along that index. Only what the index really holds is removed.

Hashes of anchors only route: different anchors under one hash are told apart by their contexts, so a clash costs volume,
not removals. Contexts (within an anchor) and windows are told apart by 64 bits of their own.

Every message is made of different hashes or of passages that a chunk needs once, so copies are collapsed before each
shuffle: a passage that a third of all documents share is sent from chunk to chunk, once to each, and no key gathers its
copies. All state is bounded by a chunk, a bucket or one document. A chunk sends at most FAN rows; where that many buckets
would be too large, a second pass deals each of them out again, so the number of rows follows the text, too.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts, ranges, settle

#: Text of a chunk, text that gives the hashes of a bucket, symbols that are worked on at a time, and buckets of a pass.
CHUNK_BYTES, BUCKET_BYTES, BLOCK, FAN = 4_000_000, 20_000_000, 1 << 18, 4096
#: Hashes that the second pass holds at a time.
MANY = 1 << 23
NONE = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def ranged(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of values[start:stop], wherever it lies."""
    return mix64((p[stop] - p[start]) * powers(len(p))[1][start])


class Bytes:
    """Texts as bytes."""

    window, gram = 100, 32

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.sizes = [len(t) for t in texts]

    def values(self, doc: int, start: int, stop: int) -> np.ndarray:
        return _BYTE[np.frombuffer(self.texts[doc], np.uint8)[start:stop]]

    def passage(self, doc: int, start: int, stop: int) -> bytes:
        return self.texts[doc][start:stop]

    def kept(self, doc: int, keep: np.ndarray) -> bytes:
        return np.frombuffer(self.texts[doc], np.uint8)[keep].tobytes()


#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 64


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: eight at a time, scrambled after each, so that no arithmetic of the bytes makes two alike.

    (A polynomial modulo 2**64 has clashes that hold for every base.)
    """
    import xxhash

    length = end - start
    h = mix64(length.astype(np.uint64) * np.uint64(_BASE))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    short = length <= _LONG_WORD
    for at in range(0, _LONG_WORD, 8):
        own = np.flatnonzero(short & (length > at))
        if not len(own):
            break
        block = np.zeros(len(own), np.uint64)
        for i in range(8):
            byte = padded[start[own] + at + i].astype(np.uint64) << np.uint64(8 * i)
            block |= np.where(at + i < length[own], byte, np.uint64(0))
        h[own] = mix64(h[own] ^ block)
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), seed=42)
    return h


class Words:
    """Texts as words between white space; a word is a hash of its bytes."""

    window, gram = 20, 6

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words: list[tuple] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < BLOCK):
                size += len(texts[stop]) + 1
                stop += 1
            raw = np.frombuffer(b" ".join(texts[at:stop]) + b" ", np.uint8)
            inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
            edge = np.flatnonzero(np.diff(inside, prepend=False))
            start, end = edge[::2], edge[1::2]
            value = word_hashes(raw, start, end)
            first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:stop]])])
            cut = np.searchsorted(start, first)
            self.words += [(value[a:b], start[a:b] - f, end[a:b] - f) for a, b, f in zip(cut, cut[1:], first)]
            at = stop
        self.sizes = [len(w[0]) for w in self.words]

    def values(self, doc: int, start: int, stop: int) -> np.ndarray:
        return self.words[doc][0][start:stop]

    def passage(self, doc: int, start: int, stop: int) -> bytes:
        _, a, b = self.words[doc]
        return self.texts[doc][a[start] : b[stop - 1]]

    def kept(self, doc: int, keep: np.ndarray) -> bytes:
        text, (_, a, b) = self.texts[doc], self.words[doc]
        return b" ".join([text[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist())])


def least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum over each w neighbours."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def scan(unit) -> tuple[np.ndarray, ...]:
    """Of all anchors: doc, first and last start of their windows, hash of the k-gram, hash of the context."""
    w, k = unit.window, unit.gram
    segments = [(d, a, min(n, a + BLOCK + w - 1)) for d, n in enumerate(unit.sizes) if n >= w for a in range(0, n - w + 1, BLOCK)]
    out, at = [], 0
    while at < len(segments):
        stop, size = at, 0
        while stop < len(segments) and (stop == at or size + segments[stop][2] - segments[stop][1] <= BLOCK):
            size += segments[stop][2] - segments[stop][1]
            stop += 1
        some = segments[at:stop]
        p = prefix(np.concatenate([unit.values(*s) for s in some]))
        length = np.array([b - a for _, a, b in some])
        base = np.cumsum(length) - length
        starts = np.arange(len(p) - k)
        gram = ranged(p, starts, starts + k)
        place = np.uint64((1 << 22) - 1)
        # The hash with its low bits replaced by the place: of equal k-grams the leftmost is least.
        anchor = (least((gram & ~place) | starts.astype(np.uint64), w - k + 1) & place).astype(np.int64)
        seg = np.repeat(np.arange(len(some)), length - w + 1)
        s = np.arange(len(seg)) + (base - (np.cumsum(length - w + 1) - (length - w + 1)))[seg]
        a = anchor[s]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (seg[1:] != seg[:-1])]))
        lo, hi, a, seg = s[new], np.concatenate([s[new[1:] - 1], s[-1:]]), a[new], seg[new]
        context = mix64(ranged(p, lo, hi + w) + (a - lo).astype(np.uint64))
        shift = (np.array([x[1] for x in some]) - base)[seg]
        out.append((np.array([x[0] for x in some])[seg], lo + shift, hi + shift, gram[a], context))
        at = stop
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in kinds)


def windows(unit, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and hash of each single window; doc is in ascending order."""
    size = hi - lo + 1
    doc, start = np.repeat(doc, size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    out = np.zeros(len(doc), np.uint64)
    at = 0
    for d in np.unique(doc).tolist():
        stop = int(np.searchsorted(doc, d, "right"))
        own = start[at:stop]
        low = int(own.min())
        for a in range(low, int(own.max()) + 1, BLOCK):
            here = np.flatnonzero((own >= a) & (own < a + BLOCK))
            p = prefix(unit.values(d, a, a + BLOCK + unit.window))
            out[at + here] = ranged(p, own[here] - a, own[here] - a + unit.window)
        at = stop
    return doc, start, out


def pack(x: np.ndarray) -> bytes:
    """Numbers in ascending order by their differences, byte plane by byte plane, as high planes hold mostly zeros."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blobs: list[bytes]) -> np.ndarray:
    planes = lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(planes(b), dtype=np.uint64) for b in blobs if b)])


def spread(h: np.ndarray) -> np.ndarray:
    """Even 32-bit numbers that choose the bucket of a hash."""
    return mix64(h) >> np.uint64(32)


def by_value(key: np.ndarray, *columns: np.ndarray):
    """Each different value of key with the rows of the columns that have it."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cut) if len(key) else []:
        yield int(key[rows[0]]), *(c[rows] for c in columns)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Intervals joined where they touch or overlap, by document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    far = int(max(hi.max() - min(lo.min(), 0), 0)) + 3
    end = np.maximum.accumulate(hi + doc * far) - doc * far
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1] + 1)])
    first = np.flatnonzero(new)
    return doc[first], lo[first], end[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def in_sorted(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _send(kind, bounds: np.ndarray, buckets: int, route: int):
    """Step 1: rows (bucket, chunks, anchors, contexts)."""

    def run(batches):
        from .common import binary

        for batch in batches:
            ids = np.array([NONE if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            texts, out = binary(batch, "text"), []
            for chunk, rows in by_value(np.searchsorted(bounds, ids, side="left"), np.arange(len(ids))):
                _, _, _, h, c = scan(kind([texts[i] for i in rows.tolist()]))
                h, c = _pairs(h >> np.uint64(64 - route), c)
                for bucket, a, b in by_value(spread(h) % np.uint64(buckets), h, c):
                    out.append((bucket, _chunks(np.full(len(a), chunk)), pack(a), b.tobytes()))
            yield _batch(out, ["bucket", "k", "a", "b"])

    return run


def _pairs(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in ascending order of h."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else order
    return h[new], c[new]


def _distinct(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first place of each different pair, in order."""
    order = np.lexsort((c, h))  # stable, so that the first of equal pairs is the first place
    return np.sort(order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])]) if len(h) else order


def _chunks(chunk: np.ndarray) -> bytes:
    """The chunk of each hash of a row, as pairs of a chunk and a count."""
    start = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    return np.stack([chunk[start], np.diff(np.concatenate([start, [len(chunk)]]))], axis=1).astype("<i4").tobytes()


def _of_chunks(blobs: list[bytes]) -> np.ndarray:
    pairs = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1])


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"bucket": pa.int64(), "chunk": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(x, pa.binary())) for i, x in enumerate(names)], names)


def _deal_again(again: int):
    """The second pass: each bucket's hashes are dealt out to ``again`` buckets, MANY at a time."""

    def split(bucket, rows):
        chunk, h = _of_chunks([r[0] for r in rows]), unpack([r[1] for r in rows])
        others = np.frombuffer(b"".join(r[2] for r in rows), "<u8")
        order = np.argsort(h, kind="stable")
        chunk, h, others = chunk[order], h[order], others[order] if len(others) else others
        for part, k, a, *b in by_value((spread(h) // np.uint64(FAN)) % np.uint64(again), chunk, h, *([others] if len(others) else [])):
            yield bucket * again + part, _chunks(k), pack(a), b[0].tobytes() if b else b""

    def run(batches):
        waiting: dict[int, list] = {}
        n = 0
        for batch in batches:
            for bucket, *row in zip(*(batch.column(x).to_pylist() for x in ("bucket", "k", "a", "b"))):
                waiting.setdefault(bucket, []).append(row)
                n += len(row[1]) // 8
                if n >= MANY:
                    yield _batch([x for b, rows in waiting.items() for x in split(b, rows)], ["bucket", "k", "a", "b"])
                    waiting, n = {}, 0
        if n:
            yield _batch([x for b, rows in waiting.items() for x in split(b, rows)], ["bucket", "k", "a", "b"])

    return run


MESSAGE = "bucket long, k binary, a binary, b binary"


def _dealt(sent: DataFrame, again: int) -> DataFrame:
    return sent if again == 1 else sent.repartition("bucket").mapInArrow(_deal_again(again), MESSAGE)


def _answer(group):
    """A bucket of step 1: to every chunk the anchors to resolve (kind 0), to the chunk before it what to supply (kind 1)."""
    import pyarrow as pa

    h, c, chunk = unpack(group.column("a").to_pylist()), np.frombuffer(b"".join(group.column("b").to_pylist()), "<u8"), _of_chunks(group.column("k").to_pylist())
    order = np.lexsort((chunk, h))
    h, c, chunk = h[order], c[order], chunk[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    group_of = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(h)]])))
    several = chunk[start] != np.maximum.reduceat(chunk, start)
    unlike = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
    resolve = np.flatnonzero((several & unlike)[group_of])
    supply = np.flatnonzero((h[1:] == h[:-1]) & (chunk[1:] != chunk[:-1]) & ~unlike[group_of[1:]]) + 1
    out = [(dest, 0, pack(np.unique(a)), b"") for dest, a in by_value(chunk[resolve], h[resolve])]
    # Any earlier chunk will do; the last before it is asked, so none has to supply a passage more than once.
    out += [(dest, 1, pack(a), to.astype("<i4").tobytes()) for dest, a, to in by_value(chunk[supply - 1], h[supply], chunk[supply])]
    return pa.Table.from_batches([_batch(out, ["chunk", "kind", "a", "b"])])


def _answer_windows(group):
    """A bucket of step 2: to the chunk before it the windows to supply (kind 2)."""
    import pyarrow as pa

    h, chunk = unpack(group.column("a").to_pylist()), _of_chunks(group.column("k").to_pylist())
    order = np.lexsort((chunk, h))
    h, chunk = h[order], chunk[order]
    later = np.flatnonzero((h[1:] == h[:-1]) & (chunk[1:] != chunk[:-1])) + 1
    out = [(dest, 2, pack(a), to.astype("<i4").tobytes()) for dest, a, to in by_value(chunk[later - 1], h[later], chunk[later])]
    return pa.Table.from_batches([_batch(out, ["chunk", "kind", "a", "b"])])


def _sorted(docs):
    """The rows of a chunk in order, and their texts."""
    import pyarrow as pa

    text = docs.column("text").cast(pa.binary()).fill_null(b"")
    docs = docs.set_column(docs.schema.get_field_index("text"), "text", text).sort_by([("key", "ascending"), ("text", "ascending")])
    return docs, docs.column("text").to_pylist()


def _asked(messages, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and targets of a kind of message, in the order of the hashes."""
    rows = [(a, b) for k, a, b in zip(messages.column("kind").to_pylist(), messages.column("a").to_pylist(), messages.column("b").to_pylist()) if k == kind]
    h, to = unpack([r[0] for r in rows]), np.frombuffer(b"".join(r[1] for r in rows), "<i4")
    order = np.argsort(h, kind="stable")
    return h[order], to[order] if kind else to


def _resolve(kind, buckets: int, route: int):
    """Step 2: rows (bucket, chunks, windows) for anchors that have several contexts."""

    def run(docs, messages):
        import pyarrow as pa

        docs, texts = _sorted(docs)
        asked, _ = _asked(messages, 0)
        out = []
        if len(asked) and len(texts):
            unit = kind(texts)
            doc, lo, hi, h, c = scan(unit)
            h = h >> np.uint64(64 - route)
            some = np.flatnonzero(in_sorted(h, asked))
            some = some[_distinct(h[some], c[some])]
            found = np.unique(windows(unit, doc[some], lo[some], hi[some])[2])
            chunk = docs.column("chunk")[0].as_py()
            out = [(bucket, _chunks(np.full(len(a), chunk)), pack(a), b"") for bucket, a in by_value(spread(found) % np.uint64(buckets), found)]
        return pa.Table.from_batches([_batch(out, ["bucket", "k", "a", "b"])])

    return run


def _joined(keys: np.ndarray, asked: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of keys and the targets that asked for them; asked is sorted, both may repeat."""
    left, right = np.searchsorted(asked, keys, "left"), np.searchsorted(asked, keys, "right")
    n = right - left
    rows = np.repeat(np.arange(len(keys)), n)
    return rows, to[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)] if len(rows) else np.zeros(0, np.int32)


def _supply(kind, route: int):
    """Step 3: rows (chunk, passages) of what other chunks need."""

    def run(docs, messages):
        import pyarrow as pa

        docs, texts = _sorted(docs)
        (whole, whole_to), (single, single_to), (several, _) = _asked(messages, 1), _asked(messages, 2), _asked(messages, 0)
        rows = []
        if (len(whole) or len(single)) and len(texts):
            unit = kind(texts)
            doc, lo, hi, h, c = scan(unit)
            h = h >> np.uint64(64 - route)
            here = np.flatnonzero(in_sorted(h, whole))
            here = here[_distinct(h[here], c[here])]  # all that are different, should several share the hash
            at, to = _joined(h[here], whole, whole_to)
            found = [(to, doc[here][at], lo[here][at], hi[here][at])]
            some = np.flatnonzero(in_sorted(h, several))
            some = some[_distinct(h[some], c[some])]
            d, s, x = windows(unit, doc[some], lo[some], hi[some])
            here = np.flatnonzero(in_sorted(x, single))
            here = here[np.unique(x[here], return_index=True)[1]]
            at, to = _joined(x[here], single, single_to)
            found.append((to, d[here][at], s[here][at], s[here][at]))
            to, doc, lo, hi = (np.concatenate(x) for x in zip(*found))
            for target, *spans in by_value(to, doc, lo, hi):
                rows.append((target, [unit.passage(d, a, b + unit.window) for d, a, b in zip(*(x.tolist() for x in merged(*spans)))]))
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "passages": pa.array([r[1] for r in rows], pa.list_(pa.binary()))})

    return run


def _own_repeats(unit, doc, lo, hi, h, c):
    """Within a chunk: intervals of windows that came before, and intervals where those came first."""
    key = mix64(h ^ mix64(c))
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = first[which] != np.arange(len(key))
    source = first[count > 1]
    heads = np.sort(first)
    _, back, n = np.unique(h[heads], return_inverse=True, return_counts=True)
    some = heads[n[back] > 1]
    d, s, x = windows(unit, doc[some], lo[some], hi[some])
    _, f, w, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    later, origin = f[w] != np.arange(len(x)), f[n > 1]
    pick = lambda i, j: tuple(np.concatenate(p) for p in ((doc[i], d[j]), (lo[i], s[j]), (hi[i], s[j])))
    return pick(np.flatnonzero(again), np.flatnonzero(later)), pick(source, origin)


def removed(kind, matcher, texts: list[bytes], passages: list[bytes]):
    """The unit of a chunk's texts, and for each text a mask of the symbols that go."""
    unit = kind(texts)
    doc, lo, hi, h, c = scan(unit)
    gone = [np.zeros(n + 1, np.int32) for n in unit.sizes]

    def mark(index, spans):
        for d, a, b in zip(*(x.tolist() for x in merged(*spans))):
            index.add(d, a, b)
        for d, a, b in index.matches(unit):
            gone[d][a] += 1
            gone[d][b + unit.window] -= 1

    if passages:
        known = np.unique(scan(kind(passages))[3])
        here = np.flatnonzero(in_sorted(h, known))
        mark(matcher(kind(passages)), (doc[here], lo[here], hi[here]))
    again, source = _own_repeats(unit, doc, lo, hi, h, c)
    if len(again[0]):
        mark(matcher(kind([unit.passage(d, a, b + unit.window) for d, a, b in zip(*(x.tolist() for x in merged(*source)))])), again)
    return unit, [np.cumsum(g[:-1]) > 0 for g in gone]


def _finish(kind, matcher, texts_too: bool):
    def run(docs, messages):
        import pyarrow as pa

        docs, texts = _sorted(docs)
        sent = sorted(x for own in messages.column("passages").to_pylist() for x in own)
        unit, masks = removed(kind, matcher, texts, sent)
        rows = []
        for i, mask in enumerate(masks):
            edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2)
            kept = unit.kept(i, ~mask)
            rows.append((len(mask), int(mask.sum()), len(edge), hashlib.sha256(kept).hexdigest(), kept if texts_too else None, edge.ravel().tolist() if texts_too else None))
        kinds = (("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64())))
        return pa.table({"doc_id": docs.column("doc_id"), **{name: pa.array([r[i] for r in rows], k) for i, (name, k) in enumerate(kinds)}})

    return run


def remove_repeats(docs: DataFrame, kind, matcher, texts_too: bool = True, route: int = 64) -> DataFrame:
    """doc_id, n (symbols), n_removed, n_spans, kept_sha256, kept (bytes) and spans (start, end, start, ...) of each row.

    A symbol goes if a window that covers it came before: in a smaller doc_id, or earlier in the same document. Rows
    without doc_id come first; rows that share one are ordered by text, so of repeated rows the first is kept whole. Null
    texts are empty; other columns are ignored; an empty table gives an empty table.

    route: bits of an anchor's hash. Fewer make more anchors share one, which changes the volume but not the result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>"
    key = F.coalesce("doc_id", F.lit(NONE).cast("long"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = ranges(docs, key, total, CHUNK_BYTES)
    buckets = max(parts(spark), math.ceil(total / BUCKET_BYTES))
    buckets, again = min(buckets, FAN), math.ceil(buckets / FAN)

    @F.pandas_udf("int")
    def chunk(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left"))

    sent = _dealt(docs.select("doc_id", "text").mapInArrow(_send(kind, bounds, buckets, route), MESSAGE), again)
    message = "chunk int, kind int, a binary, b binary"
    first = settle(sent.groupBy("bucket").applyInArrow(_answer, message))
    rows = docs.select("doc_id", key.alias("key"), "text").withColumn("chunk", chunk("key"))
    texts = rows.groupBy("chunk")
    single = texts.cogroup(first.where("kind = 0").groupBy("chunk")).applyInArrow(_resolve(kind, buckets, route), MESSAGE)
    second = _dealt(single, again).groupBy("bucket").applyInArrow(_answer_windows, message)
    passages = texts.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(_supply(kind, route), "chunk int, passages array<binary>")
    return texts.cogroup(passages.groupBy("chunk")).applyInArrow(_finish(kind, matcher, texts_too), schema)
