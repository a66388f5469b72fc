"""Byte-level BPE by recursive DuckDB queries inside each partition.

A text is cut into pieces by the tokenizer's pattern. The different pieces of a block of texts become rows (piece,
position, token); a recursive query joins neighbours with the merge table and contracts each piece's leftmost pair of
least rank until none is left, and an ordered aggregation gives the ids. Pieces met before are kept in a bounded memory
of the worker. Texts are decoded from nothing but their ids: these are joined with the vocabulary, and an ordered
aggregation puts the bytes of each text together. Pieces of over ``LONG`` bytes, for which one pass per merge would
be quadratic, are contracted by a heap in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 256
#: Pieces that a worker remembers, and code points of texts that it cuts at a time.
MEMORY, BLOCK_CHARS = 1_000_000, 2_000_000
#: Pieces are encoded together as long as their squared lengths in bytes add up to this, as the rounds of one piece make half as many rows.
SQUARES = 4_000_000
#: Ids that are decoded at a time; longer texts are decoded in parts.
MANY = 1_000_000

ENCODE = """
WITH RECURSIVE step(w, pos, nxt, tok, round) AS (
  SELECT w, pos, pos + 1, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN skip ELSE nxt END, CASE WHEN hit THEN CAST(best >> 20 AS INTEGER) ELSE tok END, round + 1
  FROM (
    SELECT step.*, best, skip, pos = (best >> 10) & 1023 AS hit FROM step JOIN (
      SELECT a.w, min((rank << 20) | (a.pos << 10) | a.nxt) AS best, arg_min(b.nxt, (rank << 20) | (a.pos << 10) | a.nxt) AS skip
      FROM step a JOIN step b ON a.w = b.w AND a.nxt = b.pos JOIN merges ON lft = a.tok AND rgt = b.tok
      GROUP BY a.w
    ) USING (w)
  )
  WHERE pos <> best & 1023
), last AS (SELECT w, max(round) AS round FROM step GROUP BY w)
SELECT w, count(*) AS n, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS ids
FROM step JOIN last USING (w, round)
GROUP BY w
"""

DECODE = "SELECT w, string_agg(bytes, '' ORDER BY pos) AS decoded, count(*) AS n FROM tokens JOIN vocabulary ON id = tok GROUP BY w"


class Codec:
    """Encodes and decodes with one vocabulary; a task makes its own and closes it, so that no worker keeps it for later stages."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes = {r: b for b, r in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        lft, rgt, rank = (pa.array(x, pa.int32()) for x in zip(*pairs)) if pairs else [pa.array([], pa.int32())] * 3
        given = {"m": pa.table({"lft": lft, "rgt": rgt, "rank": rank.cast(pa.int64())}), "v": pa.table({"id": pa.array(self.bytes, pa.int32()), "bytes": [b.hex() for b in self.bytes.values()]})}
        for name, rows in given.items():
            self.db.register(name, rows)
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v")

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        self.db.close()
        self.known.clear()

    def _rows(self, lists):
        import numpy as np
        import pyarrow as pa

        size = np.fromiter(map(len, lists), np.int64, len(lists))
        w = np.repeat(np.arange(len(lists)), size)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        tok = np.fromiter((t for own in lists for t in own), np.int32, int(size.sum()))
        return pa.table({"w": w.astype(np.int32), "pos": pos, "tok": tok})

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known yet."""
        one = [self.ranks[bytes([b])] for b in range(256)]
        short, raw = [], [p.encode() for p in pieces]
        for p, b in zip(pieces, raw):
            if (whole := self.ranks.get(b)) is not None:  # a piece that is a token needs no merges
                self.known[p] = (1, b"%d" % whole)
            elif len(b) > LONG:
                ids = self._heap(b)
                self.known[p] = (len(ids), " ".join(map(str, ids)).encode())
            else:
                short.append((p, b))
        short.sort(key=lambda x: len(x[1]))  # a query has as many rounds as its longest piece
        at = 0
        while at < len(short):
            stop, squares = at, 0
            while stop < len(short) and (stop == at or squares + len(short[stop][1]) ** 2 <= SQUARES):
                squares += len(short[stop][1]) ** 2
                stop += 1
            some, at = short[at:stop], stop
            self.db.register("start", self._rows([[one[x] for x in b] for _, b in some]))
            got = self.db.execute(ENCODE).fetchnumpy()
            self.db.unregister("start")
            for w, n, ids in zip(got["w"].tolist(), got["n"].tolist(), got["ids"].tolist()):
                self.known[some[w][0]] = (n, ids.encode())

    def _heap(self, raw: bytes) -> list[int]:
        """One long piece: the leftmost pair of least rank first, by a heap over a linked list."""
        ranks, n = self.ranks, len(raw)
        tok = [raw[i : i + 1] for i in range(n)]
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or len(tok[i]) != a or len(tok[j]) != b or not tok[i]:
                continue
            tok[i], tok[j] = tok[i] + tok[j], b""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (r := ranks.get(tok[x] + tok[nxt[x]])) is not None:
                    heapq.heappush(heap, (r, x, len(tok[x]), len(tok[nxt[x]])))
        return [ranks[t] for t in tok if t]

    def decode(self, lists) -> list[bytes]:
        """The bytes of each list of ids."""
        import numpy as np
        import pyarrow as pa

        out: list[list[str]] = [[] for _ in lists]
        parts = [(i, np.asarray(own[a : a + MANY], np.int32)) for i, own in enumerate(lists) for a in range(0, len(own), MANY)]
        at = 0
        while at < len(parts):
            stop, n = at, 0
            while stop < len(parts) and (stop == at or n + len(parts[stop][1]) <= MANY):
                n += len(parts[stop][1])
                stop += 1
            some = parts[at:stop]
            size = np.array([len(x) for _, x in some])
            w = np.repeat(np.arange(len(some), dtype=np.int32), size)
            self.db.register("tokens", pa.table({"w": w, "pos": np.arange(n, dtype=np.int32), "tok": np.concatenate([x for _, x in some])}))
            found, counted = {}, 0
            for i, spelled, ids in self.db.execute(DECODE).fetchall():
                found[i] = spelled
                counted += ids
            self.db.unregister("tokens")
            if counted != n:
                raise ValueError("an id is not in the vocabulary")
            for i, (doc, _) in enumerate(some):
                out[doc].append(found[i])
            at = stop
        return [bytes.fromhex("".join(x)) for x in out]

    def encode(self, texts: list[str]):
        """For each text: the number of ids, the ids in decimal joined by spaces, and the bytes that they decode to."""
        import numpy as np

        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= BLOCK_CHARS):
                chars += len(texts[stop])
                stop += 1
            cut = [self.cut(t) for t in texts[at:stop]]
            new = {p for own in cut for p in own}.difference(self.known)
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                new = {p for own in cut for p in own}
            self.learn(sorted(new))
            rows = []
            for own in cut:
                found = [self.known[p] for p in own]
                rows.append((sum(f[0] for f in found), b" ".join([f[1] for f in found])))
            decoded = self.decode([np.fromstring(ids, np.int32, sep=" ") if n else [] for n, ids in rows])
            yield from ((n, ids, spelled) for (n, ids), spelled in zip(rows, decoded))
            at = stop


def _run(vocabulary, pattern: str, full: bool, keep: tuple[str, ...] = ()):
    def run(batches):
        import pyarrow as pa

        sha = lambda x: hashlib.sha256(x).hexdigest()
        with Codec(vocabulary.value, pattern) as codec:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for at in range(0, len(texts), 500):
                    ids = batch.column("doc_id").slice(at, 500)
                    if full:
                        rows = [(n, [int(x) for x in i.split()], d == t.encode()) for (n, i, d), t in zip(codec.encode(texts[at : at + 500]), texts[at : at + 500])]
                        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "round_trip": pa.bool_()}
                    else:
                        rows = [(n, sha(i), sha(d)) for n, i, d in codec.encode(texts[at : at + 500])]
                        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                    kept = [batch.column(name).slice(at, 500) for name in keep]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())), *kept], ["doc_id", *kinds, *keep])

    return run


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file (its size doesn't depend on the corpus), read once on the driver, and the pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the decoded bytes are the text's) of every whole text, and the columns to keep.

    Columns to keep can't have the names of these four.

    Null and empty texts have no ids. Strings of special tokens are ordinary text. Rows are independent of each other, so
    repeated rows stay as they are; columns that aren't to be kept are ignored. An empty table gives an empty table.
    """
    if clash := {"doc_id", "n_tokens", "ids", "round_trip"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    vocabulary, pattern = _shared(docs.sparkSession, path, pattern)
    # Columns travel under plain names, as Spark's mapInArrow can't take a name with a dot.
    plain = tuple(f"kept{i}" for i in range(len(keep)))
    given = docs.select("doc_id", "text", *(F.col(f"`{name}`").alias(p) for name, p in zip(keep, plain)))
    kinds = "".join(f", {p} {given.schema[p].dataType.simpleString()}" for p in plain)
    made = given.mapInArrow(_run(vocabulary, pattern, True, plain), f"doc_id long, n_tokens long, ids array<int>, round_trip boolean{kinds}")
    return made.select("doc_id", "n_tokens", "ids", "round_trip", *(F.col(p).alias(name) for name, p in zip(keep, plain)))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and bytes from doc_id and ids; null or no ids: no bytes. An id outside the vocabulary raises."""
    vocabulary, pattern = _shared(encoded.sparkSession, path, pattern)

    def run(batches):
        import pyarrow as pa

        with Codec(vocabulary.value, pattern) as codec:
            for batch in batches:
                lists = [x or [] for x in batch.column("ids").to_pylist()]
                for at in range(0, len(lists), 500):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 500), pa.array(codec.decode(lists[at : at + 500]), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    vocabulary, pattern = _shared(spark, None, None)
    return docs.mapInArrow(_run(vocabulary, pattern, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
