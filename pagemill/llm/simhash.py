"""SimHash fingerprints, pigeonhole blocks and Hamming links.

A fingerprint of 64 bits is cut into b blocks. Two that differ in at most d bits agree in b - d blocks at least, so they
meet under one of the choose(b, b - d) keys made of b - d blocks. Equal fingerprints are grouped first, so keys are held
by different fingerprints only. Each key's fingerprints are compared by XOR and popcount, and only a spanning forest of
the links found is passed on: never all pairs. Keys held by more than ``HOT`` fingerprints go to a finer cut (6, 8, then
16 blocks); under the last one a key fixes 48 bits, so at most 65,536 fingerprints can share it.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, mix64, settle, table
from .graph import components
from .spans import Words

HOT = 8192
#: Blocks of the first cut by the number of fingerprints it is meant for (keys stay far fewer than one to a value).
CUTS = ((1 << 24, 6), (1 << 31, 7), (1 << 62, 8))
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8 (A-Z lower-cased), repeats included."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(found) - words + 1)
    one, seed = xxhash.xxh64_intdigest, SEED
    stop = end[words - 1 :] if len(found) >= words else end[-1:]
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(start[:n].tolist(), stop.tolist())), np.uint64, n)


def fold(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint as ``lanes`` 64-bit integers: each bit is 1 if set in over half the hashes."""
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        for lane in range(lanes):
            own = part if not lane else mix64(part + np.uint64(lane))
            bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _prints(words: int, lanes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [fold(shingle_hashes(t, words), lanes).astype(np.int64) for t in binary(batch, "text")]
            prints = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            column = pa.array(prints) if lanes == 1 else pa.FixedSizeListArray.from_arrays(pa.array(prints), lanes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """doc_id and fp (a long, or an array of ``lanes`` longs) of every whole text; no words (or null): zero."""
    return docs.select("doc_id", "text").mapInArrow(_prints(words, lanes), "doc_id long, fp long" if lanes == 1 else "doc_id long, fp array<long>")


def _forest(distance: int, lanes: int):
    """From rows in the order of key, edges that connect whatever lies within ``distance`` under one key."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(key)
        root = np.arange(n)
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        apart = np.bincount(run) - 1  # links that each key still lacks to be connected
        u, v = [], []
        active, step = np.arange(n), 0
        while True:
            step += 1
            active = active[active + step < n]
            active = active[(key[active] == key[active + step]) & (apart[run[active]] > 0)]
            if not len(active):
                break
            near = active[np.bitwise_count(fp[active] ^ fp[active + step]).sum(axis=1) <= distance]
            near = near[root[near] != root[near + step]]
            for i in near.tolist():
                a, b = i, i + step
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    apart[run[i]] -= 1
                    u.append(i)
                    v.append(i + step)
            if len(near):
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
        return np.array(u, np.int64), np.array(v, np.int64)

    def run(batches):
        import pyarrow as pa

        key, node, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                new_key = batch.column("key").to_numpy(zero_copy_only=False)
                new_node = batch.column("node").to_numpy(zero_copy_only=False)
                flat = batch.column("fp")
                new_fp = (flat if lanes == 1 else flat.flatten()).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, lanes)
                key, node, fp = np.concatenate([key, new_key]), np.concatenate([node, new_node]), np.concatenate([fp, new_fp])
                whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            else:
                whole = len(key)
            if whole:
                a, b = links(key[:whole], fp[:whole])
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])
                key, node, fp = key[whole:], node[whole:], fp[whole:]

    return run


def _with_end(batches):
    yield from batches
    yield None


def _keyed(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """node, fp and one row for each key: the masked bits of blocks - distance blocks, told apart by the choice of blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    return nodes.select(F.explode(keys).alias("key"), "node", "fp")


def hamming_edges(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges u, v over ``nodes`` (node long, fp long, distinct fp) that join all fingerprints within ``distance`` bits, and no others."""
    first = next(b for most, b in CUTS if nodes.count() <= most)
    edges = None
    for blocks in (first, *(b for b in (8, 16) if b > first)):
        keyed = _keyed(nodes, blocks, distance)
        last = blocks == 16
        hot = None if last else settle(keyed.groupBy("key").count().where(F.col("count") > HOT).select("key"))
        cold = keyed if last else keyed.join(hot, "key", "left_anti")
        found = cold.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_forest(distance, 1), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        if last or not hot.head(1):
            break
        nodes = settle(keyed.join(hot, "key", "left_semi").select("node", "fp").distinct())
    return edges


def link(prints: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id that can be reached over links of at most ``distance`` bits.

    Repeated rows and rows with equal fingerprints share a node; an empty table gives an empty table. Rows without doc_id
    count for links and get the component's least doc_id, or null if it has none.
    """
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = hamming_edges(nodes.select(F.col("fp").alias("node"), "fp"), distance)
    rooted = components(edges)
    placed = nodes.join(rooted, nodes.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles over all documents, linked at four or fewer differing bits."""
    prints = settle(fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))
    return link(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For the pipeline: groups of documents whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.
LANES, WORDS = 4, 5
#: Fingerprints of 256 bits (each shingle once) only screen candidates. At 4/5 a bit differs with a probability of 0.151
#: in large sets and of at most 0.1875 in the smallest (4 and 5): both bounds lie six standard deviations or more above.
BOUND, BOUND_SMALL, SMALL = 74, 88, 64
#: Nodes of a key that are screened pair by pair; beyond, neighbours in size are candidates unseen.
CROWD = 2048
#: Documents and bytes of text of a tile in which candidates are verified, and representatives that every tile sees.
TILE_DOCS, TILE_BYTES, REPRESENTATIVES = 2048, 1 << 24, 16
#: Texts whose words are held at a time.
SLICE = 256
#: Bits of a shingle's hash that choose its counter: 2**18 counters, 1 MB, whatever the corpus holds.
COUNTERS = 18


def shingle_sets(texts: list[bytes]):
    """The different five-word shingles of each text (A-Z lower-cased) as sorted hashes; fewer words: the whole sequence.

    Texts are taken ``SLICE`` at a time, so that not the words of all of them are held.
    """
    for at in range(0, len(texts), SLICE):
        for value, _, _ in Words([t.lower() for t in texts[at : at + SLICE]]).words:
            n = min(WORDS, len(value))
            h = np.full(len(value) - n + 1 if n else 0, n, np.uint64)
            for i in range(n):
                h = mix64(h + value[i : i + len(h)])
            yield np.unique(h)


def _tally(batches):
    """Counters of the shingles of a partition's texts, in slabs; most are zero or small, so they are compressed."""
    import zlib

    import pyarrow as pa

    total = np.zeros(1 << COUNTERS, np.int64)
    for batch in batches:
        waiting, n = [], 0
        for own in chain(shingle_sets(binary(batch, "text")), [None]):
            if own is not None:
                waiting.append(own)
                n += len(own)
            if waiting and (own is None or n > 1 << COUNTERS):
                total += np.bincount((np.concatenate(waiting) >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
                waiting, n = [], 0
    slabs = total.reshape(16, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in slabs], pa.binary())], ["slab", "counts"])


def _summed(group):
    import zlib

    import pyarrow as pa

    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"slab": group.column("slab").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur in all texts: what the driver gets has a fixed size."""
    import zlib

    tallied = docs.select("text").mapInArrow(_tally, "slab int, counts binary")
    # Tasks are added up in groups first, so that no group grows with their number beyond its root.
    dealt = tallied.withColumn("part", F.expr("spark_partition_id() div 64"))
    first = dealt.groupBy("slab", "part").applyInArrow(_summed, "slab int, counts binary")
    rows = first.groupBy("slab").applyInArrow(_summed, "slab int, counts binary").toArrow().sort_by("slab")
    return np.concatenate([np.frombuffer(zlib.decompress(x), np.int64) for x in rows.column("counts").to_pylist()] or [np.zeros(1 << COUNTERS, np.int64)])


def _sets(counts):
    """doc_id, th, node (a hash of the set), size, fp and prefix: the n - ceil(4n/5) + 1 rarest of n shingles.

    Two sets with a similarity of 4/5 or more share at least ceil(4n/5) shingles, so in any common order the first one
    that they share is in both prefixes (Chaudhuri et al., 2006; Bayardo et al., 2007). With rare shingles first, passages
    that many documents share are in no prefix but of documents that hold little else.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        often = counts.value
        for batch in batches:
            node, size, fp, prefix = [], [], [np.zeros(0, np.uint64)], []
            for own in shingle_sets(binary(batch, "text")):
                n = len(own)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(n)
                fp.append(fold(own, LANES))
                rare = np.lexsort((own, often[(own >> np.uint64(64 - COUNTERS)).astype(np.int64)]))
                prefix.append(own[rare[: n - -(-4 * n // 5) + 1]].view(np.int64))
            prints = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(fp).view(np.int64)), LANES).cast(pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), prints, pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "size", "fp", "prefix"])

    return run


def _shared(batches):
    """Of rows in the order of key, those whose key is held by more than one."""
    import pyarrow as pa

    key, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # before: the key of the last row passed on
    for batch in _with_end(batches):
        if batch is not None:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        upto = len(key) - (batch is not None)  # the last row waits until the next is known
        like = np.concatenate([[before is not None and key[0] == before], key[1:] == key[:-1], [False]])
        keep = (like[:-1] | like[1:])[:upto]
        yield pa.RecordBatch.from_arrays([pa.array(key[:upto][keep]), pa.array(node[:upto][keep])], ["key", "node"])
        before = key[upto - 1] if upto else before
        key, node = key[upto:], node[upto:]


def _candidates(batches):
    """From rows in the order of key and size, edges that connect whatever can be similar enough under one key."""
    import pyarrow as pa

    def links(key, size, fp, crowded):
        n = len(key)
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        many = np.bincount(run)
        chained = many > CROWD
        chained[0] |= crowded
        following = np.flatnonzero((key[1:] == key[:-1]) & chained[run[1:]] & (5 * size[:-1] >= 4 * size[1:]))
        u, v = [following], [following + 1]
        root, apart = np.arange(n), np.where(chained, 0, many - 1)  # apart: links that each key still lacks to be connected
        active, step = np.arange(n), 0
        while True:
            step += 1
            active = active[active + step < n]
            other = active + step
            on = (key[active] == key[other]) & (apart[run[active]] > 0) & (5 * size[active] >= 4 * size[other])
            active = active[on]
            if not len(active):
                break
            bound = np.where(size[active] < SMALL, BOUND_SMALL, BOUND)
            near = active[np.bitwise_count(fp[active] ^ fp[active + step]).sum(axis=1) <= bound]
            near = near[root[near] != root[near + step]]
            more = []
            for i in near.tolist():
                a, b = _root(root, i), _root(root, i + step)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    apart[run[i]] -= 1
                    more.append(i)
            if more:
                u.append(np.array(more))
                v.append(np.array(more) + step)
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
        return np.concatenate(u), np.concatenate(v)

    key, node, size, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)
    crowded = False  # whether the first row only stands for the rows before it under a crowded key
    for batch in _with_end(batches):
        if batch is not None:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column("node").to_numpy(zero_copy_only=False)])
            size = np.concatenate([size, batch.column("size").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, LANES)])
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1])) if batch is not None else len(key)  # the last key may go on
        goes_on = len(key) - whole > CROWD
        upto = len(key) if goes_on else whole
        if upto:
            a, b = links(key[:upto], size[:upto], fp[:upto], crowded)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])
            left = upto - goes_on
            key, node, size, fp, crowded = key[left:], node[left:], size[left:], fp[left:], goes_on


def _root(root: np.ndarray, a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def _verify(group):
    """Edges that connect all documents of a tile whose exact similarity is 4/5 or more, and no others.

    Those with the same ``label`` are connected already; where some are marked ``odd``, only pairs with one of them count.
    """
    import pyarrow as pa

    group = group.sort_by([("node", "ascending"), ("odd", "descending")])
    node = group.column("node").to_numpy()
    first = np.concatenate([[True], node[1:] != node[:-1]])
    node, odd, label = node[first], group.column("odd").to_numpy()[first], group.column("label").to_numpy()[first]
    sets = list(shingle_sets([t for t, one in zip(group.column("text").cast(pa.large_binary()).to_pylist(), first.tolist()) if one]))
    size = np.array([len(x) for x in sets])
    offset = np.concatenate([[0], np.cumsum(size)])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(which, kind="stable")]  # of each shingle in turn
    held = np.bincount(which)
    begin = np.cumsum(held) - held
    alone, u, v = not odd.any(), [], []
    for i in np.flatnonzero(odd | alone).tolist():
        rest = (label != label[i]) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i]))
        rest[: i + 1] &= ~(odd[: i + 1] | alone)  # pairs of the same kind were looked at before
        if not rest.any():
            continue
        ids = which[offset[i] : offset[i + 1]]
        n = held[ids]
        own = np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(holders[own], minlength=len(sets))
        near = np.flatnonzero(rest & (9 * common >= 4 * (size + size[i])))
        joined, at = np.unique(label[near], return_index=True)
        if len(joined):
            u += [node[i]] * len(joined)
            v += node[near[at]].tolist()
            label[np.isin(label, joined)] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _verified(tiled: DataFrame, *keys: str) -> DataFrame:
    """Edges of each tile. Dealt by all keys: after a join on root, grouping alone would leave a component's tiles in one task."""
    return tiled.repartition(*keys).groupBy(*keys).applyInArrow(_verify, "u long, v long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of near-duplicates: the least doc_id reached over pairs whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more.

    Pairs that can be so similar share a shingle of their prefixes, whatever the size of the corpus. Under each such key
    fingerprints screen the pairs, which gives components of candidates; a key that more than CROWD different sets hold
    makes neighbours in size candidates without a look. Inside components the sets are compared exactly, tile by tile;
    where a component has several tiles, representatives connect most of them, and only documents outside the largest
    group that results are compared with all other tiles, in blocks. So no link between different texts is lost.

    Null and empty texts have an empty set and are alike. Rows that repeat a doc_id or a text stay rows; rows without
    doc_id count for links, and get the group's least doc_id or null if it has none. An empty table gives an empty table.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    counts = spark.sparkContext.broadcast(frequencies(docs))
    prints = settle(docs.mapInArrow(_sets(counts), "doc_id long, th long, node long, size long, fp array<long>, prefix array<long>"))
    nodes = settle(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")))
    keyed = nodes.select(F.explode("prefix").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    met = keyed.mapInArrow(_shared, "key long, node long").join(nodes.select("node", "size", "fp"), "node")
    maybe = components(met.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(_candidates, "u long, v long"))

    members = nodes.select("node", "th").join(maybe, "node")
    texts = docs.select("th", "text").join(members, "th").groupBy("node", "root").agg(F.first("text").alias("text"))
    texts = settle(texts.withColumn("text", F.coalesce("text", F.lit(""))))
    total = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    tiles = total.select("root", "n", F.expr(f"int(greatest(n div {TILE_DOCS}, bytes div {TILE_BYTES})) + 1").alias("tiles"))
    placed = texts.join(tiles, "root").withColumn("tile", F.expr("int(pmod(xxhash64(node), tiles))"))
    everywhere = F.expr(f"IF(tiles > 1 AND pmod(xxhash64(1, node), n) < {REPRESENTATIVES}, sequence(0, tiles - 1), array(tile))")
    plain = (F.lit(False).alias("odd"), F.col("node").alias("label"))
    tiled = placed.select("root", "node", "text", *plain, F.explode(everywhere).alias("tile"))
    edges = _verified(tiled, "root", "tile")
    if tiles.where("tiles > 1").head(1):
        edges = settle(edges)
        edges = edges.unionByName(_between_tiles(placed.where("tiles > 1"), edges))
    rooted = components(edges)

    grouped = nodes.select("node", "least").join(rooted, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(grouped.select("node", "root").join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def _between_tiles(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between tiles: documents that aren't in the largest group of their component so far, against all the others."""
    found = components(edges).select("node", F.col("root").alias("label"))
    labelled = placed.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    most = labelled.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    labelled = labelled.join(most, "root").withColumn("odd", F.col("label") != F.col("most")).drop("most", "n")
    blocks = labelled.where("odd").select("root", F.col("tile").alias("block")).distinct()
    asking = labelled.where("odd").withColumn("block", F.col("tile")).withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    asked = labelled.join(blocks, "root").withColumn("odd", F.lit(False))
    columns = ("root", "block", "tile", "node", "text", "odd", "label")
    return _verified(asking.select(*columns).unionByName(asked.select(*columns)), "root", "block", "tile")
