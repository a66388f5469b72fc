"""Where page responses come from: captured ones, or a transport that is called once for each page task."""

from __future__ import annotations

import asyncio
import collections
import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

RESPONSE = "doc_id string, page_index int, attempt int, body string, error string"


def read_captured(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Responses kept from an earlier run; these are parsed again without asking a model."""
    return spark.read.format(format).load(path)


def infer(requests: DataFrame, transport: Callable[[str], str], *, max_attempts: int = 8, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """doc_id, page_index, attempt, body and error for each request (doc_id, page_index, payload).

    Transport errors are tried again after 1, 2, 4, then 8 seconds. Tasks can run twice, so a transport must allow that;
    write the result to a table before parsing it, so that a lost executor doesn't ask again for what was answered.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, page, payload in zip(batch.doc_id, batch.page_index, batch.payload):
                body, error, attempt = None, None, 0
                while body is None and attempt < max_attempts:
                    if attempt:
                        wait(min(2.0 ** (attempt - 1), 8.0))
                    attempt += 1
                    try:
                        body, error = transport(payload), None
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}" if str(e) else type(e).__name__
                rows.append((doc, page, attempt, body, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "attempt", "body", "error"])

    return requests.selectExpr("string(doc_id) AS doc_id", "int(page_index) AS page_index", "payload").mapInPandas(run, RESPONSE)


async def _next(pages):
    return await anext(pages, None)


class Refused(Exception):
    """A transport's answer that asking again won't change."""


#: One row for each attempt. ``fatal`` marks refusals, ``rotation`` the turn the page was asked with.
ATTEMPT = "doc_id string, page_index int, attempt int, rotation int, body string, error string, fatal boolean"


def _store(folder: str | None):
    """Reading and writing of answers by key, in files that an answer's first writer makes; nothing without a folder."""
    import posixpath
    import uuid

    from .files import file_system

    if folder is None:
        return (lambda key: None), (lambda key, answer: None)
    system, base = file_system(folder)
    system.create_dir(base)

    def read(key: str):
        from pyarrow import fs

        path = posixpath.join(base, f"{key}.json")
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def write(key: str, answer: list) -> None:
        path = posixpath.join(base, f"{key}.{uuid.uuid4().hex}")
        with system.open_output_stream(path) as f:
            f.write(json.dumps(answer).encode())
        system.move(path, posixpath.join(base, f"{key}.json"))

    return read, write


def infer_pages(
    requests: DataFrame, transport: Callable, *, window: int = 8, max_attempts: int = 8, wait: float = 1.0, store: str | None = None,
    judge: Callable[[str], tuple[bool, int]] = lambda body: (True, 0), turn: Callable[[str, int], str] = lambda payload, rotation: payload,
) -> DataFrame:
    """ATTEMPT rows for each request (doc_id, page_index, payload): the log that ``operators.documents.reduce_attempts`` takes.

    A task keeps up to ``window`` pages open at a time, and puts out their attempts in the order of the requests. A page is
    asked again after an error, ``wait`` times 1, 2, 4, then 8 seconds later, and when ``judge`` (valid, correction) calls its answer
    invalid: then ``turn`` makes its payload anew, turned by all corrections so far. ``Refused`` ends a page; so do
    ``max_attempts``. The transport takes a payload and may be a coroutine function.

    Answers aren't deterministic, and tasks can run twice. Where ``store`` names a shared folder, each attempt is kept there as
    soon as it is answered, and a task that runs again, or another run, asks only for what isn't there.
    """

    async def attempts(doc, page, payload, stored, keep):
        rows, rotation = [], 0
        for attempt in range(1, max_attempts + 1):
            asked = turn(payload, rotation)
            key = hashlib.sha256(json.dumps([doc, page, attempt, rotation, asked]).encode("utf-8", "surrogatepass")).hexdigest()
            answer = await asyncio.to_thread(stored, key)
            if answer is None:
                if attempt > 1 and rows[-1][5] is not None:
                    await asyncio.sleep(wait * min(2.0 ** (attempt - 2), 8.0))
                try:
                    body = transport(asked) if asyncio.iscoroutinefunction(transport) else asyncio.to_thread(transport, asked)
                    answer = [await body, None, False]
                except (OSError, ValueError, Refused) as e:
                    answer = [None, f"{type(e).__name__}: {e}" if str(e) else type(e).__name__, isinstance(e, Refused)]
                await asyncio.to_thread(keep, key, answer)
            rows.append((doc, page, attempt, rotation, *answer))
            if answer[2]:
                break
            if answer[1] is None:
                valid, correction = judge(answer[0])
                if valid:
                    break
                rotation = (rotation + correction) % 360
        return rows

    async def answered(requests, stored, keep):
        """Rows of pages in order; at most ``window`` pages are open or wait for an earlier one."""
        open_pages = collections.deque()
        for doc, page, payload in requests:
            open_pages.append(asyncio.ensure_future(attempts(doc, page, payload, stored, keep)))
            if len(open_pages) >= window:
                yield await open_pages.popleft()
        while open_pages:
            yield await open_pages.popleft()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stored, keep = _store(store)
        given = ((d, p, x) for batch in batches for d, p, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_index", "payload"))))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in ATTEMPT.split(", ")]
        with asyncio.Runner() as runner:
            pages = answered(given, stored, keep)
            while (rows := runner.run(_next(pages))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    return requests.selectExpr("string(doc_id) AS doc_id", "int(page_index) AS page_index", "payload").mapInArrow(run, ATTEMPT)
