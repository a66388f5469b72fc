"""A Merkle manifest of a dataset, and a proof for each of its documents, by pointer jumping.

Documents are leaves of a ternary tree for each source; the sources' roots are leaves of one more tree. Trees are built some
levels at a time from nodes that lie side by side. Then each node holds a segment: the siblings on its way to an ancestor.
Joining nodes with their ancestors doubles the distance and joins the segments end to end, so after a number of rounds
that is the logarithm of the height every leaf's segment reaches the root.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, settle, table
from .ranks import numbered

FANOUT = 3
#: Levels built at a time: a task holds the FANOUT ** LEVELS nodes below one node.
LEVELS = 6
#: The tree over the sources' roots; the others are named by their first leaf's number.
TOP = -1
#: Ancestors of at most so many bytes are sent to all tasks.
SENT = 16 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ID = ("tree", "level", "pos")
_NODE = "tree long, level int, pos long, digest binary, last boolean, segment binary, shape binary, doc_id long, leaf binary, tampered binary"


def _leaf(*values: Column) -> Column:
    """Digest of the values, each told apart by its length."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def _node(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def _climb(batches):
    """Nodes below one node LEVELS above, as rows with their siblings; then that node, or the root if all of the tree is there."""
    import pyarrow as pa

    for batch in batches:
        rows = {c: [] for c in (x.split()[0] for x in _NODE.split(", "))}

        def add(*values):
            for column, value in zip(rows.values(), values):
                column.append(value)

        for tree, level, nodes in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "nodes"))):
            nodes.sort(key=lambda x: x["position"])
            first, whole = nodes[0]["position"], nodes[0]["position"] == 0 and nodes[-1]["last"]
            digests, last = [x["digest"] for x in nodes], nodes[-1]["last"]
            for step in range(LEVELS):
                if whole and len(digests) == 1:
                    break
                above = []
                for a in range(0, len(digests), FANOUT):
                    run = digests[a : a + FANOUT]
                    for i in range(len(run)):
                        own = nodes[a + i] if step == 0 else {}
                        siblings = b"".join(run[:i] + run[i + 1 :])
                        add(tree, level + step, first + a + i, None, None, siblings, bytes([i * 4 + len(run)]), own.get("doc_id"), own["digest"] if own and level == 0 else None, own.get("tampered"))
                    above.append(_node(run))
                digests, first = above, first // FANOUT
            else:
                step = LEVELS
            own = nodes[0] if step == 0 else {}
            add(tree, level + step, first, digests[0], last, None, None, own.get("doc_id"), own["digest"] if own and level == 0 else None, own.get("tampered"))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], [*rows])


def _height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def _build(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All nodes below the roots (a table for every LEVELS levels), and the roots, of trees whose highest has that height.

    ``leaves`` has tree, position, last and digest, and what a leaf carries.
    """
    level, tables, roots = 0, [], []
    at = leaves.withColumn("level", F.lit(0))
    for _ in range(max(1, -(-height // LEVELS))):
        node = F.struct("position", "digest", "last", "doc_id", "tampered")
        groups = at.groupBy("tree", "level", F.expr(f"position div {FANOUT**LEVELS}").alias("part")).agg(F.collect_list(node).alias("nodes"))
        made = settle(groups.select("tree", "level", "nodes").mapInArrow(_climb, _NODE))
        tables.append(made.where("digest IS NULL"))
        root = F.expr("pos = 0 AND last")
        roots.append(made.where(F.col("digest").isNotNull() & root))
        level += LEVELS
        at = made.where(F.col("digest").isNotNull() & ~root).select("tree", "level", F.col("pos").alias("position"), "digest", "last", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))
    tops = roots[0]
    for more in roots[1:]:
        tops = tops.unionByName(more)
    return tables, tops


def _jump(nodes: DataFrame, top: int, height: int, most: list[int]) -> DataFrame:
    """Segments joined until all nodes point to the root, node (TOP, top, 0).

    ``height`` is the longest way from a leaf to the root, and ``most`` bounds the number of nodes on each level and above.
    """
    wide = parts(nodes.sparkSession)
    done = F.expr(f"up_tree = {TOP} AND up_level = {top} AND up_pos = 0")
    finished, distance = [nodes.where(done & F.col("leaf").isNotNull())], 1
    names = [f"{c}_" for c in ("up_tree", "up_level", "up_pos", "segment", "shape", "subroot")]
    while distance < height:
        ancestors = nodes.where(f"tree = {TOP} OR level >= {distance}")
        right = ancestors.select(*(F.col(c).alias(f"up_{c}") for c in _ID), *(F.col(c[:-1]).alias(c) for c in names))
        # An ancestor at distance d has up to 3 ** d nodes below it: from distance 16 on this is a hot key, but ancestors are few then.
        if most[min(distance, len(most) - 1)] * (128 + 65 * distance) <= SENT:
            right = F.broadcast(right)
        joined = nodes.where(~done).join(right, [f"up_{c}" for c in _ID])
        stepped = joined.select(
            *_ID, F.col("up_tree_").alias("up_tree"), F.col("up_level_").alias("up_level"), F.col("up_pos_").alias("up_pos"), F.concat("segment", "segment_").alias("segment"),
            F.concat("shape", "shape_").alias("shape"), F.coalesce("subroot", "subroot_").alias("subroot"), "doc_id", "leaf", "tampered",
        )
        # Other nodes that point to the root already stay, as ancestors; a union has the tasks of both sides.
        nodes = settle(stepped.unionByName(nodes.where(done & F.col("leaf").isNull())).coalesce(wide))
        finished.append(nodes.where(done & F.col("leaf").isNotNull()))
        distance *= 2
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    return every.coalesce(wide)


def fold(leaf: bytes, segment: bytes, shape: bytes) -> str:
    """The root, in hex, that a leaf and its siblings give; each byte of ``shape`` is 4 times a node's place in its run, plus the run's size."""
    hexed, at, digest = segment.hex(), 0, leaf.hex()
    for byte in shape:
        i, n = divmod(byte, 4)
        left, right = at + 64 * i, at + 64 * (n - 1)
        digest, at = sha256((hexed[at:left] + digest + hexed[left:right]).encode()).hexdigest(), right
    return digest


def _verify(root: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("leaf", "tampered", "segment", "shape", "subroot")]
            folded = [fold(t or leaf, segment, shape) for leaf, t, segment, shape, _ in zip(*rows)]
            text = lambda v: pa.array(v, pa.string())
            columns = [batch.column("doc_id"), text([x.hex() for x in rows[0]]), text([x.hex() for x in rows[4]]), text([root] * len(folded)), text([sha256(x.hex().encode()).hexdigest() for x in rows[2]]), text(folded), pa.array([x == root for x in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, str | None]:
    """A row for each document (doc_id, leaf, tampered, subroot, segment, shape), and the root in hex.

    Rows of a source are ordered by doc_id (null first), rows that repeat a doc_id by their digest; equal rows are leaves of their
    own. A null source comes first and is a source like others. ``tampered`` is the digest of what a document is replaced
    by (null: nothing). Null fields have a digest unlike empty ones. Other columns are ignored. No documents: no rows and
    no root.
    """
    leaves = docs.select("source", "doc_id", _leaf(*(F.col(c) for c in FIELDS)).alias("digest"), (F.lit(None).cast("binary") if tampered is None else tampered).alias("tampered"))
    placed = numbered(leaves, ["source"], ["doc_id", "digest"])
    tables, subroots = _build(placed.rows.withColumn("tree", F.col("group_start")).drop("source"), _height(placed.largest))
    ranked = numbered(subroots.select("tree", "level", "digest", "doc_id", "leaf", "tampered"), [], ["tree"])
    top = _height(ranked.largest)
    carried = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")]
    entries = ranked.rows.select(F.lit(TOP).cast("long").alias("tree"), "position", "last", "digest", *carried)
    above, roots = _build(entries, top)
    root = roots.first()
    pointer = lambda tree, level, pos: [tree.cast("long").alias("up_tree"), level.cast("int").alias("up_level"), pos.cast("long").alias("up_pos")]
    up = pointer(F.col("tree"), F.col("level") + 1, F.expr(f"pos div {FANOUT}"))
    none = F.lit(None).cast("binary")
    nodes = ranked.rows.select(
        "tree", "level", F.lit(0).cast("long").alias("pos"), *pointer(F.lit(TOP), F.lit(0), F.col("position")), F.lit(b"").alias("segment"), F.lit(b"").alias("shape"),
        F.col("digest").alias("subroot"), "doc_id", "leaf", "tampered",
    )
    for made in tables:
        nodes = nodes.unionByName(made.select(*_ID, *up, "segment", "shape", none.alias("subroot"), "doc_id", "leaf", "tampered"))
    for made in above:
        nodes = nodes.unionByName(made.select(*_ID, *up, "segment", "shape", none.alias("subroot"), *carried[:1], none.alias("leaf"), *carried[1:]))
    height = _height(placed.largest)
    most = [int(1.5 * placed.total / FANOUT**level) + 2 * ranked.total * (height + 2) for level in range(height + 1)]
    wide = nodes.coalesce(parts(docs.sparkSession))
    proofs = _jump(wide, top, height + 1 + top, most).select("doc_id", "leaf", "tampered", "subroot", "segment", "shape")
    return proofs, root and root.digest.hex()


def verify(proofs: DataFrame, root: str | None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest's rows, whose replaced leaves are folded instead."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs.mapInArrow(_verify(root), schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose id has an even checksum are verified without their line feeds."""
    docs = table(spark, sf_dir, "documents", *FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = F.replace("text", F.lit("\n"), F.lit(""))
    return verify(*manifest(docs, F.when(even, _leaf(*(joined if c == "text" else F.col(c) for c in FIELDS)))))


OP11_SQL = r"""
WITH RECURSIVE
-- CRC-32 by its rule: the table of 256 entries, then one step for each digit.
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, crc_table),
-- octet length of a string: of its blob
said AS (
  SELECT rid, doc_id, source, crc,
    coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS bare
  FROM d),
leaves AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(octet_length(encode(bare)) || ':' || bare, '-')) END AS tampered
  FROM said),
placed AS (SELECT rid, doc_id, leaf, tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (SELECT tree, level, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3),
-- Runs of both kinds of trees; the levels over the sources' roots follow those of the source's own tree.
runs AS (
  SELECT tree, level, pos // 3 AS part, list(digest ORDER BY pos) AS run FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 0, level, pos // 3, list(digest ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT rid, level AS step, pos // (3 ** level)::BIGINT AS pos, tree, level FROM (SELECT rid, pos, tree, unnest(range((SELECT level FROM subroots s WHERE s.tree = placed.tree))) AS level FROM placed)
  UNION ALL
  SELECT rid, own + level, pos // (3 ** level)::BIGINT, 0, level FROM (SELECT rid, s.level AS own, s.pos, unnest(range((SELECT max(level) FROM top))) AS level FROM placed JOIN subroots s USING (tree))),
ways AS (
  SELECT rid, step, run[:i - 1] AS before, run[i + 1:] AS after
  FROM (SELECT rid, step, run, (steps.pos % 3 + 1)::BIGINT AS i FROM steps JOIN runs ON steps.tree = runs.tree AND steps.level = runs.level AND runs.part = steps.pos // 3)),
way AS (SELECT rid, list(struct_pack(b := array_to_string(before, ''), a := array_to_string(after, '')) ORDER BY step) AS way FROM ways GROUP BY rid),
fold AS (
  SELECT rid, 0 AS hop, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT rid, hop + 1, sha256(way[hop + 1].b || digest || way[hop + 1].a) FROM fold JOIN way USING (rid) WHERE hop < len(way))
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(array_to_string(list_transform(way, lambda x: x.b || x.a), ''), '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed LEFT JOIN way USING (rid) JOIN subroots s USING (tree), (SELECT digest FROM top WHERE n = 1) r, fold f
WHERE f.rid = placed.rid AND f.hop = coalesce(len(way), 0)
"""
