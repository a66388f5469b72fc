"""Quality rules: counts of words, symbols and repeats, and a log-likelihood ratio between trusted and raw text.

Texts are bags of character n-grams, hashed to ``BUCKETS`` buckets. Two multinomials are counted, one over the trusted
documents and one over the whole corpus; a document's score is the log of the ratio of its likelihoods under both, divided
by its number of n-grams. Every document is judged by one threshold. The weights of the buckets are whole numbers
(``ONE`` is 1 nat), so that sums, and verdicts with them, don't depend on the order of addition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table

#: A prime, so that a remainder spreads n-grams well; bounds what reaches the driver and what is broadcast (0.5 MB).
BUCKETS = 65_521
ORDER, BASE, ONE = 3, 65_599, 1 << 20
#: Least log-likelihood ratio for each n-gram, in nats, of a document that is kept.
THRESHOLD = -0.5
SYMBOLS = b"#*$%&|<>"
#: Fewest words, largest percentage of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3


def grams(text: str) -> np.ndarray:
    """The bucket of each n-gram of code points of the text, which counts as having a space at both ends."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(code) < ORDER:
        return np.zeros(0, np.int64)
    key = np.zeros(len(code) - ORDER + 1, np.int64)
    for i in range(ORDER):
        key = key * BASE + code[i : len(code) - ORDER + 1 + i]
    return key % BUCKETS


def _pieces(batches, size: int = 1 << 20):
    """The texts of batches, some million characters at a time; a longer text comes alone."""
    for batch in batches:
        waiting, held = [], 0
        for text in batch.column("text").to_pylist():
            waiting.append(text or "")
            held += len(waiting[-1])
            if held >= size:
                yield waiting
                waiting, held = [], 0
        yield waiting


def _count(batches):
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for texts in _pieces(batches):
        if texts:
            total += np.bincount(np.concatenate([grams(x) for x in texts]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of ``docs``; null texts count as empty. One number for each bucket reaches the driver."""
    rows = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def weights(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
    """The log-likelihood ratio of each bucket in units of 1 / ONE nats, both counts smoothed by a half; None if nothing is trusted."""
    if not trusted.sum():
        return None
    log = lambda n: np.log((n + 0.5) / (n.sum() + 0.5 * BUCKETS))
    return np.round((log(trusted) - log(raw)) * ONE).astype(np.int64)


def trusted_of(labels: DataFrame) -> DataFrame:
    """doc_id of documents that some label calls of quality 1 and none of its fields toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray | None:
    """Weights from all documents against those whose doc_id is in ``trusted``.

    The semi-join is a shuffle at every size, as labels grow with the corpus; texts aren't sorted for it.
    """
    return weights(counts(docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")), counts(docs))


def rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text. Words are parted by ASCII white space."""
    words = raw.split()
    n = len(words)
    word_chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words) if not raw.isascii() else sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= WINDOW:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        key = ids[: n - WINDOW + 1]
        for i in range(1, WINDOW):
            # Windows are numbered anew with each word, so that keys are exact however many words there are.
            _, key = np.unique(key * len(known) + ids[i : n - WINDOW + 1 + i], return_inverse=True)
        often = np.bincount(key)[key] > 1
        covered = np.zeros(n, bool)
        for i in range(WINDOW):
            covered[i : n - WINDOW + 1 + i] |= often
        repeated = int(covered.sum())
    return n, word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def score(texts: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its weights and its number of n-grams."""
    found = [grams(x) for x in texts]
    return np.array([weight[x].sum() for x in found], np.int64), np.array([len(x) for x in found], np.int64)


def judge(docs: DataFrame, weight: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr, a row for each row.

    Null texts are empty: they fail the base rules. Without weights (nothing was trusted) the base rules alone decide and llr
    is null, as it is for a text without n-grams. Repeated rows are judged alike; an empty table gives an empty one. Columns
    besides doc_id and text are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        import pyarrow as pa

        weight = shared.value
        for whole in batches:
            # A few documents at a time bound what is held besides the batch.
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw = binary(batch, "text")
                found = np.array([rules(x) for x in raw], np.int64).reshape(-1, 5)
                failed = (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])
                kept, llr = ~failed, [None] * len(raw)
                if weight is not None:
                    total, n = score([x or "" for x in batch.column("text").to_pylist()], weight)
                    llr = [t / (ONE * k) if k else None for t, k in zip(total.tolist(), n.tolist())]
                    kept &= np.array([x is not None and x >= threshold for x in llr], bool)
                columns = [batch.column("doc_id"), *(pa.array(found[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(llr, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged against those that ``labels`` trusts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, fit(docs, trusted_of(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL),
grams AS (
  SELECT rid, doc_id, ((unicode(code[i])::BIGINT * 65599 + unicode(code[i + 1])) * 65599 + unicode(code[i + 2])) % 65521 AS bucket
  FROM (SELECT rid, doc_id, code, unnest(range(1, len(code) - 1)) AS i FROM (SELECT rid, doc_id, regexp_extract_all(' ' || text || ' ', '(?s).') AS code FROM d WHERE length(text) > 0))),
raw AS (SELECT bucket, count(*) AS n FROM grams GROUP BY bucket),
extra AS (SELECT bucket, count(*) AS n FROM grams WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY bucket),
total AS (SELECT (SELECT sum(n) FROM raw) AS raw, (SELECT sum(n) FROM extra) AS good),
weight AS (
  SELECT raw.bucket, CAST(round((ln((coalesce(extra.n, 0) + 0.5::DOUBLE) / (total.good + 0.5::DOUBLE * 65521)) - ln((raw.n + 0.5::DOUBLE) / (total.raw + 0.5::DOUBLE * 65521))) * 1048576) AS BIGINT) AS w
  FROM raw LEFT JOIN extra USING (bucket), total),
scored AS (SELECT rid, sum(w)::BIGINT AS s, count(*) AS n FROM grams JOIN weight USING (bucket) GROUP BY rid),
words AS (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d)),
windows AS (SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS said FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
often AS (SELECT rid, pos FROM windows WHERE said IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, said) > 1),
covered AS (SELECT rid, count(DISTINCT pos + k) AS n FROM often, range(3) AS r(k) GROUP BY rid),
spoken AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN spoken USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (total.good IS NULL OR coalesce(s / (1048576 * scored.n) >= -0.5, false)) AS kept,
  CASE WHEN total.good IS NOT NULL THEN s / (1048576 * scored.n) END AS llr
FROM base LEFT JOIN scored USING (rid), total
"""
