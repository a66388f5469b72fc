"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the n-grams (hashed to ``BUCKETS`` buckets) are summed by language over all labelled documents; the matrix of
log-probabilities has one row for each bucket and one column for each language, so its size is bounded by parameters.
It is broadcast; a batch of texts is a sparse matrix of n-grams, whose product with it gives all scores at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table

BUCKETS = 1 << 15
ORDERS = (2, 3)
#: More languages than this are refused, which bounds the broadcast matrix to 32 MB.
LANGUAGES = 256
UNKNOWN = "und"
BLOCK = 1 << 18


def grams(text: str) -> np.ndarray:
    """The bucket of each n-gram of code points of the lower-cased text, which counts as having a space at both ends."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h + code[i : len(code) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _count(batches):
    import pyarrow as pa

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        waiting: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            own = waiting.setdefault(lang, [])
            own.append(grams(text))
            if len(own) >= 64:
                total[lang] = total.get(lang, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
                own.clear()
        for lang, own in waiting.items():
            total[lang] = total.get(lang, np.zeros(BUCKETS, np.int64)) + (np.bincount(np.concatenate(own), minlength=BUCKETS) if own else 0)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    """languages, and log-probabilities with a row for each bucket."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most likely language of each text and its posterior probability (uniform prior); ``und`` and 0 without a letter.

        The n-grams of BLOCK places are looked up at a time, and added up by text; a longer text has several rows.
        """
        total, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        rows, owner, size = [], [], 0

        def add():
            if rows:
                start = np.cumsum([0, *map(len, rows[:-1])])
                np.add.at(total, owner, np.add.reduceat(self.logs[np.concatenate(rows)], start, axis=0, dtype=np.float64))
            rows.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if text is None or not self.languages or not any(map(str.isalpha, text)):
                continue
            known[i] = True
            at = grams(text)
            for a in range(0, len(at), BLOCK):
                rows.append(at[a : a + BLOCK])
                owner.append(i)
                size += len(rows[-1])
                if size >= BLOCK:
                    add()
                    size = 0
        add()
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, sure, 0.0)


def fit(labelled: DataFrame) -> Model:
    """From columns text and lang; rows where either is null don't count. Ties between languages go to the first in order.

    Every labelled row counts. What reaches the driver is one number for each language and bucket in use.
    """
    known = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.limit(LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table_ = np.zeros((BUCKETS, len(languages)))
    where = {x: i for i, x in enumerate(languages)}
    table_[rows.column("bucket").to_numpy(), [where[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    smooth = table_ + 0.5
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if languages else table_)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; text alone is looked at.

    Null texts, and texts without a letter, are ``und`` with a score of 0. Each row is taken on its own, so repeated rows
    have equal predictions; an empty table gives an empty table. Columns named lang_pred or score are refused.
    """
    spark = docs.sparkSession
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    shared = spark.sparkContext.broadcast((model.languages, model.logs))

    def run(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            names, scores = own.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """A quarter of the documents, by a checksum of their id; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from those that aren't held out."""
    model = fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~held_out()))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held_out())
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")
