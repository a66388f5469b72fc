"""Structure repair of conversations by rank-convergent, parallel dynamic programming.

A conversation's rows become one byte each and are cut into chunks. From right to left, a chunk turns the costs of finishing
from each state after it into those before it. All chunks start at once, from a speculative cost vector; a chunk whose
right neighbour ended in a vector that isn't its own start, up to a constant, runs again, until none does. The stitched costs then
drive a trace from left to right, whose chunks start from a speculative state and are mended in the same way. A hot
conversation is thus spread over tasks; only the bytes of one chunk are held at a time.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .ranks import numbered

#: Rows of a chunk (a byte each). Passes are at worst as many as a conversation has chunks; one is usual.
CHUNK = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults of a row; a row's byte is 4 times its fault, plus its initial's place in "sua" (3: any other).
GOOD, BLANK, DUPLICATE, CUT = range(4)
S, U, A, OTHER = range(4)
#: States: nothing yet, after system, after user, after assistant. Where a written user or assistant row leads, and a kept row.
WRITTEN = (2, 2, 3, 2)
KEPT = {(0, S): 1, (0, U): 2, (1, U): 2, (3, U): 2, (2, A): 3}
LEGAL = {(S, U), (U, A), (A, U)}
START, ROLES = 0, {2: "user", 3: "assistant"}
#: Costs of ending, by state: no more, two rows, one row, no more.
END = (0, 2 * INSERT, INSERT, 0)
#: What chunks start from before their neighbours are known.
GUESSED_COSTS, GUESSED_STATE = END, 3


def _edits(code: int, after: tuple, state: int):
    """The edits of a row in a state that don't insert: letter, cost with what follows, next state."""
    fault, initial = divmod(code, 4)
    yield "D", DELETE + after[state], state
    if fault in (GOOD, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if (state, initial) in KEPT:
            yield "K", extra + after[KEPT[state, initial]], KEPT[state, initial]
        yield "R", REROLE + extra + after[WRITTEN[state]], WRITTEN[state]


def _costs(code: int, after: tuple) -> list[int]:
    """Least cost of the rest from each state before a row, from those after it."""
    best = [min(cost for _, cost, _ in _edits(code, after, s)) for s in range(4)]
    for _ in range(2):  # at most two rows are inserted in a row
        best = [min(best[s], INSERT + best[WRITTEN[s]]) for s in range(4)]
    return best


@lru_cache(maxsize=1 << 16)
def before(code: int, after: tuple) -> tuple[tuple, int]:
    """The costs before a row less their least, and that least."""
    best = _costs(code, after)
    return tuple(x - min(best) for x in best), min(best)


@lru_cache(maxsize=1 << 16)
def choice(code: int, after: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a row, with inserts before it, and the next state."""
    best, said = _costs(code, after), ""
    while True:
        options = [(letter, to) for letter, cost, to in _edits(code, after, state) if cost == best[state]]
        if INSERT + best[WRITTEN[state]] == best[state]:
            options.append(("I", WRITTEN[state]))
        letter, state = min(options)
        said += letter
        if letter != "I":
            return said, state


def backward(codes: bytes, after: tuple) -> list[tuple]:
    """Normalised costs before each row, first to last, and after the last."""
    out = [after]
    for code in reversed(codes):
        after = before(code, after)[0]
        out.append(after)
    return out[::-1]


def forward(codes: bytes, costs: list[tuple], state: int, final: bool) -> tuple[str, int, int]:
    """Edits, their cost, and the state after the last row (with what must be added at the end, if ``final``)."""
    said, cost = [], 0
    for i, code in enumerate(codes):
        letters, state = choice(code, costs[i + 1], state)
        said.append(letters)
        edit = letters[-1]
        cost += INSERT * (len(letters) - 1) + {"D": DELETE, "K": 0, "R": REROLE}[edit] + (TRUNCATED if edit != "D" and code // 4 == CUT else 0)
    missing = END[state] // INSERT if final else 0
    return "".join(said) + "I" * missing, cost + INSERT * missing, state


_STATE = "conv long, chunk long, final boolean, codes binary, used binary, out binary, entry int, leaves int, audit string, cost long, again boolean"


def _chunks(batches):
    """Codes in order; the first, speculative run of costs."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for conv, chunk, final, listed in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "final", "listed"))):
            codes = bytes(x["code"] for x in sorted(listed, key=lambda x: x["position"]))
            used = END if final else GUESSED_COSTS
            rows.append((conv, chunk, final, codes, bytes(used), bytes(backward(codes, used)[0]), None, None, None, None, False))
        yield _batch(pa, rows)


def _batch(pa, rows):
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}
    names = [x.split() for x in _STATE.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(columns, names)], [n for n, _ in names])


def _again(batches):
    """Chunks whose neighbour's costs aren't those they started from run again."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            wanted = r.pop("beside")
            r["again"] = wanted is not None and wanted != r["used"]
            if r["again"]:
                r |= {"used": wanted, "out": bytes(backward(r["codes"], tuple(wanted))[0])}
            rows.append(tuple(r.values()))
        yield _batch(pa, rows)


def _trace(batches):
    """Edits of each chunk that has none yet, or whose neighbour ends in another state than it started from."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            left = r.pop("beside", None)
            entry = START if r["chunk"] == 0 else GUESSED_STATE if left is None else left
            r["again"] = entry != r["entry"]
            if r["again"]:
                audit, cost, state = forward(r["codes"], backward(r["codes"], tuple(r["used"])), entry, r["final"])
                r |= {"entry": entry, "leaves": state, "audit": audit, "cost": cost}
            rows.append(tuple(r.values()))
        yield _batch(pa, rows)


def _mended(state: DataFrame, column: str, step: int, run) -> DataFrame:
    """Passes over chunks until what each started from is what its neighbour gave."""
    while True:
        beside = state.select("conv", (F.col("chunk") + step).alias("chunk"), F.col(column).alias("beside"))
        state = settle(state.join(beside, ["conv", "chunk"], "left").select(*state.columns, "beside").mapInArrow(run, _STATE))
        if state.where("again").isEmpty():
            return state


def solve(coded: DataFrame, chunk: int | None = None) -> DataFrame:
    """Cheapest edits of conversations: conv, chunk, entry (the state before it), audit, cost; a row for each chunk.

    ``coded`` has conv, position (from 0, without gaps), last and code. Null codes aren't allowed; no rows: no rows.
    """
    part = F.expr(f"position div {chunk or CHUNK}").alias("chunk")
    listed = coded.groupBy("conv", part).agg(F.collect_list(F.struct("position", "code")).alias("listed"), F.max("last").alias("final"))
    state = settle(listed.mapInArrow(_chunks, _STATE))
    single = state.where("final AND chunk = 0").mapInArrow(_trace, _STATE)
    parted = state.where("NOT (final AND chunk = 0)")
    if not parted.isEmpty():
        costs = _mended(parted, "out", -1, _again)
        single = single.unionByName(_mended(settle(costs.mapInArrow(_trace, _STATE)), "leaves", 1, _trace))
    return single.select("conv", "chunk", "entry", "audit", "cost")


def _filled(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows with conv (the number of rows before the conversation), position and last.

    Rows are in the order of turn (null first), then role, then the digest of their text. Null roles and texts become
    a space; a null conv_id is a conversation of its own. Other columns are dropped.
    """
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"))
    rows = rows.withColumn("said", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return numbered(rows, ["conv_id"], ["turn", "role", "said"]).rows.withColumnRenamed("group_start", "conv")


def judged(rows: DataFrame) -> DataFrame:
    """conv, conv_id, position, last, turn and code of ordered rows. A role without a letter, or with another initial, can't be kept."""
    last_letter = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv", "conv_id", "position", "last", "turn", "role", "said", F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER).alias("initial"),
        (last_letter == "").alias("blank"), (~last_letter.isin(".", "!", "?")).alias("cut"),
    )
    first = narrow.groupBy("conv", "role", "said").agg(F.min("position").alias("position")).select("conv", "position", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(GOOD)
    return narrow.join(first, ["conv", "position"], "left").select("conv", "conv_id", "position", "last", "turn", (fault * 4 + F.col("initial")).cast("int").alias("code"))


def _edited(batches):
    """What chunks become: (conv, chunk, None, None) where one begins, then conv, chunk, role and text of each repaired row.

    Rows come sorted by conv and position, each chunk's edits before its rows.
    """
    conv, chunk, state, edits, at = None, None, START, "", 0

    def inserts():
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state, at = WRITTEN[state], at + 1
            yield conv, chunk, ROLES[state], ""

    for batch in batches:
        for own, part, audit, entry, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "audit", "entry", "role", "text"))):
            yield from inserts()
            if audit is not None:
                conv, chunk, edits, at, state = own, part, audit, 0, entry
                yield conv, chunk, None, None
                continue
            edit, at = edits[at], at + 1
            if edit == "K":
                state = KEPT[state, "sua".index(role[0])]
                yield conv, chunk, role, text
            elif edit == "R":
                state = WRITTEN[state]
                yield conv, chunk, ROLES[state], text
    yield from inserts()


def _stream(rows: DataFrame, solved: DataFrame, chunk: int, *by: str) -> DataFrame:
    none = F.lit(None).cast("string")
    part = F.expr(f"position div {chunk}").alias("chunk")
    told = solved.select("conv", "chunk", (F.col("chunk") * chunk - F.lit(0.5)).alias("place"), "audit", "entry", none.alias("role"), none.alias("text"))
    texts = rows.select("conv", part, F.col("position").cast("double").alias("place"), none.alias("audit"), F.lit(None).cast("int").alias("entry"), "role", "text")
    return told.unionByName(texts).repartition(*by).sortWithinPartitions("conv", "place")


def _digests(batches):
    import pyarrow as pa

    convs, shas, current, first = [], [], None, True
    for conv, _, role, text in _edited(batches):
        if not convs or conv != convs[-1]:
            if current:
                shas.append(current.hexdigest())
            convs.append(conv)
            current, first = sha256(), True
        if role is not None:
            current.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    if current:
        shas.append(current.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(shas, pa.string())], ["conv", "repaired_sha256"])


def _lines(batches, size: int = 10_000):
    import pyarrow as pa

    names, kinds = ["conv", "chunk", "line", "role", "text"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    rows, line = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    for conv, chunk, role, text in _edited(batches):
        line = 0 if role is None else line + 1
        if line:
            rows.append((conv, chunk, line, role, text))
        if len(rows) >= size:
            yield out()
            rows = []
    yield out()


class Repair:
    """rows (ordered, with conv and position), code of each, and solved: the cheapest edits of each chunk.

    Valid conversations have the initials ``(s?(ua)+)?``. Keep costs nothing, Rerole 1, Delete 2 (which blank rows and those
    whose role and text came earlier must have), Insert 5; a truncated row that isn't deleted costs 5 more. Of equally cheap
    edits the ASCII-least initials are taken. No conversations: no rows.
    """

    def __init__(self, conversations: DataFrame, chunk: int | None = None):
        self.chunk = chunk or CHUNK
        self.rows = ordered(conversations)
        self.coded = settle(judged(self.rows))
        self.solved = settle(solve(self.coded, self.chunk))

    def repaired(self) -> DataFrame:
        """conv, chunk, line (from 1, within the chunk), role and text: the repaired rows, dealt by chunk."""
        return _stream(self.rows, self.solved, self.chunk, "conv", "chunk").mapInArrow(_lines, "conv long, chunk long, line long, role string, text string")

    def digests(self) -> DataFrame:
        """conv and repaired_sha256. A digest is of one conversation's text in order, so a task streams it, a batch at a time."""
        return _stream(self.rows, self.solved, self.chunk, "conv").mapInArrow(_digests, "conv long, repaired_sha256 string")

    def report(self) -> DataFrame:
        """conv_id, conv, gaps, blank, duplicate, truncated, illegal, cost and audit, a row for each conversation."""
        count = lambda c: F.sum(c.cast("long"))
        fault, initial = F.expr("code div 4"), F.col("code") % 4
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
        counted = self.coded.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), *(count(fault == i).alias(c) for c, i in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))))
        here = self.coded.select("conv", "position", initial.alias("here"))
        pairs = here.join(here.select("conv", (F.col("position") - 1).alias("position"), F.col("here").alias("next")), ["conv", "position"])
        legal = " OR ".join(f"(here = {a} AND next = {b})" for a, b in sorted(LEGAL))
        illegal = pairs.groupBy("conv").agg(count(~F.expr(legal)).alias("illegal"))
        edits = self.solved.groupBy("conv").agg(F.sum("cost").alias("cost"), F.expr("array_join(transform(array_sort(collect_list(struct(chunk, audit))), x -> x.audit), '')").alias("audit"))
        return counted.join(illegal, "conv", "left").join(edits, "conv").withColumn("illegal", F.coalesce("illegal", F.lit(0).cast("long")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn`` (nulls, in the key as in role and text, are one space).

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 takes out full stops, question and exclamation marks, 3 repeats it, 4
    makes it the user's.
    """
    by = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), by.alias("by")).where("by <> 0")
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("array_repeat(0, IF(by = 3, 2, 1))")).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those without rows after the damage have zeros, no edits and no text."""
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repair = Repair(damage(conversations))
    done = repair.report().join(repair.digests(), "conv").withColumn("conv_key", F.col("conv_id"))
    every = conversations.select("conv_id").distinct()
    joined = every.join(done.drop("conv_id"), every.conv_id.eqNullSafe(F.col("conv_key")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE
-- CRC-32 by its rule: the table of 256 entries, then one step for each character.
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS harm
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE harm <> 0),
placed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
judged AS (
  SELECT conv, conv_id, turn, role, text, pos, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS next,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
-- For each state (nothing, after system, user, assistant) the cheapest edits so far; struct order is cost, then edits.
best AS (
  SELECT conv, 0::BIGINT AS pos, {'c': 0, 'a': ''} AS s0, {'c': 9999999, 'a': ''} AS s1, {'c': 5, 'a': 'I'} AS s2, {'c': 10, 'a': 'II'} AS s3 FROM (SELECT DISTINCT conv FROM placed)
  UNION ALL
  SELECT conv, pos, s0, s1, s2, list_min([s3, {'c': s2.c + 5, 'a': s2.a || 'I'}]) FROM (
    SELECT conv, pos, s0, s1, list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I'}, {'c': s1.c + 5, 'a': s1.a || 'I'}, {'c': s3.c + 5, 'a': s3.a || 'I'}]) AS s2, s3 FROM (
      SELECT conv, pos, {'c': s0.c + 2, 'a': s0.a || 'D'} AS s0,
        list_min([{'c': s1.c + 2, 'a': s1.a || 'D'}, {'c': CASE WHEN free AND initial = 's' THEN s0.c + p ELSE 9999999 END, 'a': s0.a || 'K'}]) AS s1,
        list_min([{'c': s2.c + 2, 'a': s2.a || 'D'}]
          || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN free AND initial = 'u' THEN s.c + p ELSE 9999999 END, 'a': s.a || 'K'})
          || list_transform([s0, s1, s3], lambda s: {'c': CASE WHEN free THEN s.c + p + 1 ELSE 9999999 END, 'a': s.a || 'R'})) AS s2,
        list_min([{'c': s3.c + 2, 'a': s3.a || 'D'}, {'c': CASE WHEN free AND initial = 'a' THEN s2.c + p ELSE 9999999 END, 'a': s2.a || 'K'}, {'c': CASE WHEN free THEN s2.c + p + 1 ELSE 9999999 END, 'a': s2.a || 'R'}]) AS s3
      FROM (SELECT b.*, j.pos, initial, fault IN ('', 'truncated') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS p FROM best b JOIN judged j ON j.conv = b.conv AND j.pos = b.pos + 1) AS r(conv, was, s0, s1, s2, s3, pos, initial, free, p)))),
edits AS (SELECT conv, list_min([s0, s3]) AS won FROM best QUALIFY pos = max(pos) OVER (PARTITION BY conv)),
letters AS (SELECT conv, j, won.a[j] AS letter FROM (SELECT conv, won, unnest(range(1, length(won.a) + 1)) AS j FROM edits)),
counted AS (SELECT conv, j, letter, count(*) FILTER (letter <> 'I') OVER w AS taken, count(*) FILTER (letter <> 'D') OVER w AS line FROM letters WINDOW w AS (PARTITION BY conv ORDER BY j)),
written AS (
  SELECT c.conv, j, letter, line, initial, role, text, max(CASE WHEN line = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv) AS led
  FROM counted c LEFT JOIN judged g ON g.conv = c.conv AND g.pos = c.taken AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS said
  FROM written GROUP BY conv),
told AS (
  SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(won.c, 0)::BIGINT AS cost, coalesce(won.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id AND told.conv IS NOT NULL LEFT JOIN edits USING (conv) LEFT JOIN repaired USING (conv)
"""
