"""From raw documents to token ids, in five stages.

Every stage takes an empty table to an empty one, keeps rows that repeat (unless it says otherwise) and all columns of
``documents``, and ignores what others hold, whatever their names and nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import bpe, language, lines, mixing, simhash
from pagemill.llm.common import settle

#: The columns of documents.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with what isn't a column of documents in one struct, rest_, whatever it is named; and what undoes that."""
    others = [c for c in docs.columns if c not in OWN]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(None).cast("struct<c0: int>")

    def unpack(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in OWN else F.col("rest_")[f"c{others.index(c)}"].alias(c) for c in docs.columns))

    return docs.select(*(c for c in OWN if c in docs.columns), rest.alias("rest_")), unpack


#: A prediction below this posterior probability counts as no language.
SURE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; those without a letter (or null, or empty), or too unsure, go.

    Learned from rows with text and lang that aren't held out. Equal texts share their fate.
    """
    docs, unpack = _packed(docs)
    model = language.fit(docs.where(~language.held_out()))
    return unpack(language.predict(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that came earlier: equal at any length but zero, or nearly so; n_chars follows.

    All documents stay, also those that lose all their lines. Null texts stay null. Of rows that tie in doc_id, the lesser
    hash of the text comes first; rows that repeat a doc_id and its text are one document and keep the same lines.
    """
    docs, unpack = _packed(docs)
    return unpack(lines.dedup_lines(docs, exact_chars=1).withColumn("n_chars", F.length("text").cast("long")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates.

    Null and empty texts are alike, so one of them stays. All rows that repeat the kept doc_id stay; a group without any
    doc_id stays whole.
    """
    kept = simhash.near_groups(docs).where("doc_id <=> component_id").select("doc_id")
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; source becomes a struct of its name and the document's mix_slot and mix_position.

    A null source is a source of its own. Equal doc_ids are ordered at will, but each row has a position of its own.
    """
    docs, unpack = _packed(docs)
    placed = F.struct(F.col("source").alias("name"), "mix_slot", "mix_position")
    return unpack(mixing.mix(docs, resolution=None).withColumn("source", placed))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, whether they decode to the text, and mix_slot and mix_position of documents that are mixed.

    Null and empty texts have no ids.
    """
    source = docs.schema["source"].dataType
    place = ("mix_slot", "mix_position") if isinstance(source, T.StructType) and {"mix_slot", "mix_position"} <= set(source.names) else ()
    return bpe.encode(docs.select("doc_id", "text", *(F.col("source")[c].alias(c) for c in place)), keep=place)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokens),
]

#: No SQL for naive Bayes, fingerprints or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
