"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line of the corpus (smaller doc_id, then text hash, then line number) is equal or within
``threshold`` edits; lines of under ``min_chars`` code points go only if equal, and stay if under ``exact_chars``. What is earlier is judged on the input, so a
line goes even if the earlier one goes too.

Different lines are cut into threshold + 1 even segments. Lines within the threshold share one whole segment, at a place
that the lengths bound: each line looks up, for all lengths it could match and all segments, the substrings of its own
that could be that segment (Li et al., Pass-Join, 2011). The lines under one key are compared by banded edit distance,
and those that go are passed on, never pairs. A key that more than ``TILE`` lines share is cut again: what the shared
segment leaves of its lines is cut into ``FINER`` segments, all but one of which must be shared, and so on, until one
symbol is left; there the earliest line under a key decides. (Thresholds other than one are compared tile by tile there.)

Few lines share a key with another. Which keys different lines share is told from hashes alone, a Bloom filter of them is
broadcast, and only lines that pass it are shuffled as text; what it passes in error is met by no other line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

MIN_CHARS = 20
THRESHOLD = 1
TILE = 64
FINER = 16
#: Bits of the Bloom filter for each shared key, and at least and at most in all (2**27: 16 MB). A fuller one passes more lines.
FILTER_BITS = 32
FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 27


def _keys(threshold: int, min_chars: int, longest: int | None = None) -> tuple[list[Column], list[int]]:
    """The keys that a line (columns line and n, its length) probes, null where it can't; and which of them it is found by.

    Others may be longer by ``longest`` (the threshold unless given).
    """
    size, keys, own = F.col("n"), [], []
    for delta in range(-(threshold if longest is None else longest), threshold + 1):  # own length minus the other's
        other = size - delta
        for i in range(threshold + 1):
            begin = F.expr(f"((n - {delta}) * {i}) div {threshold + 1}").cast("int")
            length = F.expr(f"((n - {delta}) * {i + 1}) div {threshold + 1}").cast("int") - begin
            for shift in range(max(-i, delta - (threshold - i)), min(i, delta + (threshold - i)) + 1):
                at = begin + shift
                fits = (at >= 0) & (at + length <= size) & (other >= min_chars)
                if delta == 0 and shift == 0:
                    own.append(len(keys))
                keys.append(F.when(fits, F.xxhash64(other, F.lit(i), F.substring(F.col("line"), at + 1, length))))
    return keys, own


def _named(docs: DataFrame) -> DataFrame:
    """Adds k and th, which tell documents apart: the id (the least number if there is none) and a hash of the text."""
    return docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("th", F.xxhash64("text"))


def first_lines(named: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k, th and nos: the numbers of the lines of each document that no earlier line equals, of those that can go."""
    lines = named.select("k", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.length("line") >= min_chars)
    digests = lines.select(F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(1), F.col("line")).alias("d2"), "k", "th", "no")
    first = digests.groupBy("d1", "d2").agg(F.min(F.struct("k", "th", "no")).alias("at"))
    return first.groupBy("at.k", "at.th").agg(F.collect_list("at.no").alias("nos"))


def _filter(keys: DataFrame, n: int) -> DataFrame:
    """One row: words, a Bloom filter of the n keys with two bits for each, as blocks of 1,024 words of 64 bits."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * n - 1).bit_length()))
    own = F.expr(f"explode(array(key & {bits - 1}, shiftrightunsigned(key, 32) & {bits - 1}))")
    marks = keys.select(own.alias("bit")).groupBy(F.expr("bit >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    every = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(marks, "word", "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    inner = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "bits"))), lambda x: x["bits"])
    blocks = every.groupBy(F.expr("word >> 10").alias("block")).agg(inner("word").alias("bits"))
    return blocks.agg(inner("block").alias("words")).withColumn("mask", F.lit(bits - 1).cast("long"))


def _passes(keys: str) -> Column:
    """Whether the filter (words, mask) has both bits of any of the keys."""
    bit = lambda at: f"shiftright(words[int(({at} & mask) >> 16)][int((({at} & mask) >> 6) & 1023)], int({at} & 63))"
    return F.expr(f"exists({keys}, key -> ({bit('key')} & {bit('shiftrightunsigned(key, 32)')} & 1) = 1)")


def met_lines(named: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame | None:
    """k, th, no, line: where each different line first stands, of those that share a key with another, and few more; None if none do.

    The longer of two lines looks for the shorter one, so that keys of longer others aren't needed here.
    """
    lines = named.select("k", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    keys = _keys(threshold, min_chars, longest=0)[0]
    keyed = lines.select(F.xxhash64("line").alias("d"), F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")
    shared = settle(keyed.groupBy("key").agg(F.min("d").alias("one"), F.max("d").alias("two")).where("one != two").select("key"))
    if not (n := shared.count()):
        return None
    probes = lines.select("k", "th", "no", "line", F.array_compact(F.array(*keys)).alias("keys"))
    # A join with one row, the filter: no line meets another here.
    met = probes.join(F.broadcast(_filter(shared, n)), _passes("keys"), "left_semi")
    return settle(met.groupBy("line").agg(F.min(F.struct("k", "th", "no")).alias("at")).select("at.*", "line"))


def near_lines(different: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """k, th, no of the different lines (k, th, no, line) that an earlier one is within the threshold of."""
    lines = different.withColumn("d", F.xxhash64("line"))
    keys, own = _keys(threshold, min_chars)
    keyed = lines.select("d", "line", F.length("line").alias("n")).select("d", F.posexplode(F.array(*keys)).alias("i", "key")).where("key IS NOT NULL").withColumn("indexed", F.col("i").isin(own))
    shared = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("found")).where("n > 1 AND found").select("key", "n"))
    met = keyed.join(shared, "key").join(lines, "d").withColumn("at", F.struct("k", "th", "no"))
    near = _compared(met.where(f"n <= {TILE}"), "line", threshold)
    if shared.where(f"n > {TILE}").head(1):
        crowded = met.where(f"n > {TILE}")
        near = near.unionByName(_crowded(crowded) if threshold == 1 else _tiled(crowded, threshold))
    return near.distinct()


def _compared(met: DataFrame, text: str, threshold: int) -> DataFrame:
    """k, th, no of the lines (key, at, indexed, text) that an earlier indexed one of their key is within the threshold of."""
    held = F.collect_list(F.struct("at", "indexed", F.col(text).alias("text")))
    close = lambda x, h: h["indexed"] & (h["at"] < x["at"]) & (F.levenshtein(h["text"], x["text"], threshold) >= 0)
    gone = F.filter("held", lambda x: F.exists("held", lambda h: close(x, h)))
    return met.groupBy("key").agg(held.alias("held")).select(F.inline(F.transform(gone, lambda x: x["at"])))


def _crowded(met: DataFrame) -> DataFrame:
    """The same for keys of many lines, at most one edit apart: finer and finer cuts of what a key leaves open.

    Rows (key, at, indexed, rest, s): rest is what the line has between the shared parts, s the length of an indexed rest.
    """
    # Of the six keys of a line, three for each segment: the other's length is the own one, minus the edit.
    segment, delta = F.expr("i % 2"), F.expr("i div 2 - 1")
    first = F.expr("(length(line) - (i div 2 - 1)) div 2").cast("int")
    rest = F.when(segment == 0, F.substring(F.col("line"), first + 1, F.length("line"))).otherwise(F.substring(F.col("line"), F.lit(1), first + delta.cast("int")))
    s = F.when(segment == 0, F.length("line") - delta - first).otherwise(first)
    rows, near = met.select("key", "at", "indexed", rest.alias("rest"), s.cast("int").alias("s")), None
    while True:
        found = _closed(rows.where("s <= 1"))
        begin, end = F.expr(f"(s * j) div {FINER}").cast("int"), F.expr(f"(s * (j + 1)) div {FINER}").cast("int")
        cut = rows.where("s > 1").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(FINER - 1)))).withColumns({"begin": begin, "end": end})
        cut = cut.withColumn("own", F.expr("length(rest) - s + end - begin")).where("own >= 0")
        before, after = F.substring(F.col("rest"), F.lit(1), F.col("begin")), F.substring(F.col("rest"), F.col("begin") + F.col("own") + 1, F.length("rest"))
        finer = cut.select(F.xxhash64("key", "j", before, after).alias("key"), "at", "indexed", F.substring("rest", F.col("begin") + 1, F.col("own")).alias("rest"), (F.col("end") - F.col("begin")).alias("s"))
        shared = settle(finer.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("found")).where("n > 1 AND found").select("key", "n"))
        finer = settle(finer.join(shared, "key"))
        found = found.unionByName(_compared(finer.where(f"n <= {TILE}"), "rest", 1))
        near = found if near is None else near.unionByName(found)
        rows = finer.where(f"n > {TILE}").drop("n")
        if not rows.head(1):
            return near


def _closed(rows: DataFrame) -> DataFrame:
    """Where one symbol or none is left of the indexed lines: all lines of a key are near, but those of two symbols only to either."""
    key = lambda *c: F.xxhash64("key", *c)
    asked = F.when(F.length("rest") - F.col("s") == 1, F.when(F.col("s") == 0, F.array(key())).otherwise(F.array(key(F.substring("rest", 1, 1)), key(F.substring("rest", 2, 1))))).otherwise(F.array(key()))
    held = rows.where("indexed").select(F.explode(F.array(key(), key("rest"))).alias("key"), "at").groupBy("key").agg(F.min("at").alias("first"))
    return rows.select(F.explode(asked).alias("key"), "at").join(held, "key").where("first < at").select("at.*")


def _tiled(met: DataFrame, threshold: int) -> DataFrame:
    """The same for keys of many lines and any threshold: a tile holds some of the lines, and a line meets every tile of its key."""
    met = met.withColumn("tiles", F.expr(f"int(n div {TILE}) + 1"))
    tiles = met.where("indexed").groupBy("key", F.expr("int(pmod(d, tiles))").alias("tile")).agg(F.collect_list(F.struct("at", "line")).alias("held"))
    probes = met.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "at", "line")
    close = F.exists("held", lambda h: (h["at"] < F.col("at")) & (F.levenshtein(h["line"], F.col("line"), threshold) >= 0))
    return probes.join(tiles, ["key", "tile"]).where(close).select("at.*")


def kept_lines(named: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """k, th and nos: the numbers of the lines, of those that can go, that stay."""
    first = settle(first_lines(named, min_chars if exact_chars is None else exact_chars))
    met = met_lines(named, threshold, min_chars)
    if met is None:
        return first.select("k", "th", F.array_sort("nos").alias("nos"))
    gone = near_lines(met, threshold, min_chars).groupBy("k", "th").agg(F.collect_list("no").alias("gone"))
    left = F.when(F.col("gone").isNull(), F.col("nos")).otherwise(F.array_except("nos", "gone"))
    return first.join(gone, ["k", "th"], "left").select("k", "th", F.array_sort(left).alias("nos"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with the text that stays, n_lines and n_removed.

    Lines of ``exact_chars`` (min_chars unless given) code points or more go if an earlier one is equal, those of
    ``min_chars`` or more also if one is near.

    Lines end at a line feed; the remaining ones are joined by line feeds. Null texts stay null and have no lines, an
    empty text has one. Rows that repeat a doc_id and its text are one document; of ties in doc_id the lesser hash of the
    text comes first. Rows without doc_id come before all others. An empty table gives an empty table. Other columns stay
    as they are, whatever their names; only n_lines and n_removed are refused.
    """
    if clash := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    # Other columns travel in one of their own, so that no name can clash. The id is taken from k afterwards, so that all
    # steps ask for the same columns and share one shuffle of the texts.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(None)
    named = _named(docs.select("doc_id", "text", rest.alias("rest"))).drop("doc_id")
    joined = named.join(kept_lines(named.select("text", "k", "th"), threshold, min_chars, exact_chars), ["k", "th"], "left").withColumn("doc_id", F.when(F.col("k") != -(1 << 63), F.col("k")))
    short = F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) < (min_chars if exact_chars is None else exact_chars), i)), lambda i: i.isNotNull())
    left = F.array_sort(F.concat(short, F.coalesce("nos", F.expr("CAST(array() AS array<int>)"))))
    kept = F.when(F.col("text").isNotNull(), F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    count = lambda c: F.coalesce(F.when(F.col("text").isNotNull(), c), F.lit(0)).cast("long")
    out = {"doc_id": F.col("doc_id"), "text": kept, **{c: F.col(f"rest.c{i}") for i, c in enumerate(others)}}
    return joined.withColumn("lines", F.split("text", "\n")).withColumn("left", left).select(
        *(out[c].alias(c) for c in docs.columns), count(F.size("lines")).alias("n_lines"), count(F.size("lines") - F.size("left")).alias("n_removed")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of all documents."""
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, no, lines[no] AS line, length(lines[no]) AS n
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), d AS (SELECT line, any_value(n) AS n, min((doc_id, no)) AS first FROM l WHERE n >= 20 GROUP BY line),
probe AS (SELECT line, n, first, unnest([n - 1, n, n + 1]) AS m FROM d),
near AS (
  SELECT a.line FROM probe a JOIN d b ON b.n = a.m AND left(b.line, a.m // 2) = left(a.line, a.m // 2) AND b.first < a.first AND levenshtein(a.line, b.line) <= 1
  UNION SELECT a.line FROM probe a JOIN d b ON b.n = a.m AND right(b.line, a.m - a.m // 2) = right(a.line, a.m - a.m // 2) AND b.first < a.first AND levenshtein(a.line, b.line) <= 1
), kept AS (
  SELECT l.* FROM l LEFT JOIN d USING (line) WHERE l.n < 20 OR (d.first = (l.doc_id, l.no) AND l.line NOT IN (SELECT line FROM near))
), k AS (SELECT doc_id, count(*) AS c, string_agg(line, chr(10) ORDER BY no) AS t FROM kept GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n.c, 0) AS n_lines, coalesce(n.c, 0) - coalesce(k.c, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
