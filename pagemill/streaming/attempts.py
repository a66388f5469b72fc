"""Attempts at pages as a stream: what is known of each page is state, and the wait before its next attempt a timer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a page's attempts have come to. ``tries`` counts attempts; a page that is over takes no more.
STATE = (
    "tries int, turned int, over boolean, status string, attempts int, applied_rotation int, error string, prompt_tokens long, completion_tokens long"
)
#: ``kind`` is page (what is known so far) or retry (the next attempt is due, turned by next_rotation).
RESULT = f"doc_id long, page_index int, kind string, {STATE}, next_attempt int, next_rotation int"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
_ROW = [x.split()[0] for x in RESULT.split(", ")]


def advance(page: dict | None, row: dict, max_attempts: int) -> dict:
    """The state of a page after one more attempt (outcome, correction, error and tokens)."""
    page = dict(page or {"tries": 0, "turned": 0, "over": False, "status": "failed", "attempts": 0, "applied_rotation": 0, "error": None, "prompt_tokens": 0, "completion_tokens": 0})
    if page["over"]:
        return page
    outcome, page["tries"] = row["outcome"], page["tries"] + 1
    said = {"prompt_tokens": row["prompt_tokens"] or 0, "completion_tokens": row["completion_tokens"] or 0}
    if outcome == "valid" or outcome == "invalid":
        page |= {"status": "valid" if outcome == "valid" else "retained", "attempts": page["tries"], "applied_rotation": page["turned"], "error": None, **said}
    elif page["status"] == "failed":
        page |= {"attempts": page["tries"], "error": row["error"]} | (said if outcome == "fatal" else {})
    if outcome == "invalid":
        page["turned"] = (page["turned"] + (row["correction"] or 0)) % 360
    page["over"] = outcome in ("valid", "fatal") or page["tries"] >= max_attempts
    return page


class Attempts(StatefulProcessor):
    """One page: a state of a few numbers, and at most one timer."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", STATE)

    def _known(self) -> dict | None:
        return dict(zip(_NAMES, self.page.get())) if self.page.exists() else None

    def _row(self, key, kind: str, page: dict, following: int | None = None) -> Row:
        turned = page["turned"] if following else None
        return Row(*_ROW)(*key, kind, *(page[c] for c in _NAMES), following, turned)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        page = self._known()
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            page = advance(page, row.asDict(), self.max_attempts)
        self.page.update(tuple(page[c] for c in _NAMES))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not page["over"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * min(2 ** (page["tries"] - 1), 8))
        yield self._row(key, "page", page)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        page = self._known()
        if page and not page["over"]:
            yield self._row(key, "retry", page, page["tries"] + 1)

    def close(self) -> None:
        pass


def track(stream: DataFrame, max_attempts: int = 8) -> DataFrame:
    """Rows of RESULT from a stream of attempts (doc_id, page_index, at, seq, outcome, correction, error, tokens).

    Attempts at a page are numbered as they arrive, those of one batch by at and seq. Each batch puts out what is now known of
    the pages it touches, by the rules of ``operators.documents.reduce_attempts``. A page that isn't over asks for its next
    attempt 1, 2, 4, then 8 seconds after the last one, unless a row of it comes first.
    """
    keyed = stream.groupBy("doc_id", "page_index")
    return keyed.transformWithState(statefulProcessor=Attempts(max_attempts), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime")


def latest(results: DataFrame) -> DataFrame:
    """One row for each page, as ``reduce_attempts`` gives: that of its last batch."""
    columns = ["status", "attempts", "applied_rotation", "error", "prompt_tokens", "completion_tokens"]
    known = results.where("kind = 'page'").groupBy("doc_id", "page_index").agg(F.max_by(F.struct(*columns), "tries").alias("r"))
    return known.select("doc_id", "page_index", "r.*")


def due(results: DataFrame) -> DataFrame:
    """doc_id, page_index, next_attempt and next_rotation of pages whose next attempt is due and hasn't come."""
    last = results.groupBy("doc_id", "page_index").agg(F.max("tries").alias("tries"))
    return results.where("kind = 'retry'").join(last, ["doc_id", "page_index", "tries"], "left_semi").select("doc_id", "page_index", "next_attempt", "next_rotation").distinct()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Queries started inside have these settings."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: State with timers is kept in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: With timers there is always another batch to run, so a query that is to end runs batches for data alone; timers that have
#: gone off by then are served in the same batch.
DATA_ALONE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def follow(stream: DataFrame, folder: str, every: str = "1 second", max_attempts: int = 8) -> StreamingQuery:
    """A query that goes on: retries appear in ``folder``/rows as their waits end, also while nothing arrives."""
    with settings(stream.sparkSession, **STATE_STORE):
        return _into(track(stream, max_attempts), folder).trigger(processingTime=every).start()


def _into(results: DataFrame, folder: str):
    return results.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")


def drain(stream: DataFrame, folder: str, max_attempts: int = 8) -> DataFrame:
    """Everything that has arrived, tracked and appended to ``folder``/rows; its checkpoint lies beside it. A run goes on where the last one ended."""
    with settings(stream.sparkSession, **STATE_STORE, **DATA_ALONE):
        _into(track(stream, max_attempts), folder).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(RESULT).parquet(f"{folder}/rows")
