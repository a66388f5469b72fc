"""Chat formatting from an event log, in DataFrame functions only.

Events of a conversation are ordered by sequence number: ``open`` starts a turn with its role, ``delta`` appends text,
``edit`` replaces all of the turn's text so far, and ``regenerate`` discards it. A conversation is folded into its final
messages and rendered with marks that no text can hold, as ``&`` and ``<`` inside texts become ``&amp;`` and ``&lt;``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Roles whose texts a model is trained on.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text from events (conv_id, turn, seq, kind, role, text).

    The final text of a turn is the text of its last open, edit or regenerate event, followed by all later deltas in the
    order of seq. Null texts are empty; the role is that of the last event that has one (none: empty). Events with equal
    seq come in the order open, regenerate, edit, delta, then by text. Unknown kinds raise.
    """
    rank = F.expr("CASE kind WHEN 'open' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 WHEN 'delta' THEN 3 ELSE raise_error(concat('unknown kind of event: ', kind)) END")
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role")
    listed = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    base = F.expr("array_max(transform(log, (e, i) -> IF(e.rank < 3, i, 0)))")
    kept = F.expr("slice(log, base + 1, size(log))")
    text = F.expr("array_join(transform(filter(kept, e -> e.rank <> 1), e -> e.text), '')")
    role = F.coalesce(F.expr("get(filter(transform(reverse(log), e -> e.role), r -> r IS NOT NULL), 0)"), F.lit(""))
    return listed.withColumn("base", base).withColumn("kept", kept).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, order: str = "turn") -> DataFrame:
    """conv_id and formatted: one string for each conversation. Messages of one turn follow by role, then text.

    Null roles and texts are empty; repeated rows are messages of their own; no rows: no rows. Other columns are ignored.
    """
    piece = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", "text", piece.alias("piece"))))
    return messages.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.expr("array_join(transform(rows, r -> r.piece), '')").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """A row for each turn, read back from ``formatted``: conv_id, no (from 0), role, text, and start and end of the text as
    it is written there (escaped), in code points. What stands before a turn is a running sum, so the work is linear.

    Repeated conv_ids are taken for one conversation; no rows: no rows. Other columns are ignored.
    """
    # Escaped texts hold no '<', so a mark is always a mark.
    pieces = F.expr("slice(split(formatted, '<[|]end[|]>', -1), 1, size(split(formatted, '<[|]end[|]>', -1)) - 1)")
    rows = formatted.select("conv_id", F.posexplode(pieces).alias("no", "piece"))
    head = F.instr("piece", TEXT) + len(TEXT) - 1
    before = Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("piece") + len(END)).over(before), F.lit(0))
    placed = rows.withColumns({"head": head, "offset": offset.cast("long")})
    role = F.substring("piece", F.lit(len(TURN) + 1), F.col("head") - len(TURN) - len(TEXT))
    text = F.substring("piece", F.col("head") + 1, F.length("piece"))
    return placed.select("conv_id", "no", unescape(role).alias("role"), unescape(text).alias("text"), (F.col("offset") + F.col("head")).alias("start"), (F.col("offset") + F.length("piece")).alias("end"))


def loss_spans(parsed: DataFrame, role: str = LEARNED) -> DataFrame:
    """The turns that a loss is taken over: their spans [start, end) are the loss mask of ``formatted``."""
    return parsed.where(F.col("role") == role)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: counts, and digests of all turns and of the text under the loss mask.

    A conversation without turns has no row, as ``render`` makes none.
    """
    masked = parse(formatted).withColumn("mask", F.col("role") == LEARNED)
    every = F.array_sort(F.collect_list(F.struct("no", "role", "text", "mask")))
    read = masked.groupBy("conv_id").agg(every.alias("turns"), F.max("end").alias("last"))
    said = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    read = read.withColumn("learned", F.expr("array_join(transform(filter(turns, t -> t.mask), t -> t.text), '')"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), (F.col("last") + len(END)).alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A log for plain turns, with every kind of event. Rows that share a turn are turns of their own.

    A learned turn is opened, streams a draft that is discarded by ``regenerate``, and streams its text in two deltas. Any
    other is opened with a wrong text, which an ``edit`` replaces by its first half; a delta appends the rest. Turns are
    numbered by (turn, role, text), so that repeated rows keep their count. Other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = conversations.select("conv_id", (F.row_number().over(order) - 1).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.expr("length(text) div 2").cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    silent, role = F.lit(None).cast("string"), F.col("role")
    learned = F.array(event(0, "open", role, F.lit("")), event(1, "delta", silent, rest), event(2, "regenerate", silent, silent), event(3, "delta", silent, first), event(4, "delta", silent, rest))
    other = F.array(event(0, "open", role, rest), event(1, "edit", silent, first), event(2, "delta", silent, rest))
    return turns.select("conv_id", "turn", F.inline(F.when(role == LEARNED, learned).otherwise(other)))


#: Holds what would be control strings elsewhere.
CANARY = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, as logs of events, folded, rendered and read back."""
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CANARY).alias("text")) for i, r in enumerate(("user", "assistant"))))))
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    return digest(render(fold(events_of(rows))))


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), folded AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length('<|turn|><|text|><|end|>') + length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM folded
"""
