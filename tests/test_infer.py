import json
import os
import threading
import time

import pytest

from pagemill.operators import documents as D
from pagemill.sources import responses as R


def asked(spark, n, parts=2):
    return spark.createDataFrame([(i, 0, f"p{i}") for i in range(n)], "doc_id long, page_index int, payload string").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")


def recorder(folder, answer, pause=0.02):
    """A transport that leaves a line for each request, and the most requests open in its process."""
    state = {"open": 0, "lock": None}

    def transport(payload):
        state["lock"] = state["lock"] or threading.Lock()
        with state["lock"]:
            state["open"] += 1
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.write(json.dumps([payload, state["open"]]) + "\n")
        time.sleep(pause)
        with state["lock"]:
            state["open"] -= 1
        return answer(payload)

    return transport


def seen(folder):
    return [json.loads(line) for name in os.listdir(folder) for line in open(f"{folder}/{name}")]


def test_window_and_order(spark, tmp_path):
    rows = R.infer_pages(asked(spark, 60, 1), recorder(tmp_path, str.upper), window=5).collect()
    assert [(r.doc_id, r.body, r.attempt) for r in rows] == [(str(i), f"P{i}", 1) for i in range(60)]
    most = max(n for _, n in seen(tmp_path))
    assert 2 <= most <= 5


def test_turns_waits_and_refusals(spark, tmp_path):
    def answer(payload):
        name, turned = payload.split("@")
        if name == "p0":
            return f"turn 90|{turned}" if turned in ("0", "90") else f"fine|{turned}"
        if name == "p1":
            raise R.Refused("no")
        if name == "p2":
            raise OSError("busy")
        return f"fine|{turned}"

    judge = lambda body: (body.startswith("fine"), 90)
    rows = R.infer_pages(asked(spark, 4), answer, max_attempts=4, wait=0.001, judge=judge, turn=lambda p, r: f"{p}@{r}").collect()
    of = {str(i): [(r.attempt, r.rotation, r.error, r.fatal) for r in rows if r.doc_id == str(i)] for i in range(4)}
    assert of["0"] == [(1, 0, None, False), (2, 90, None, False), (3, 180, None, False)]
    assert of["1"] == [(1, 0, "Refused: no", True)]
    assert of["2"] == [(k, 0, "OSError: busy", False) for k in range(1, 5)] and of["3"] == [(1, 0, None, False)]
    log = [(r.doc_id, r.page_index, r.attempt, ("fatal" if r.fatal else "error") if r.error else ("valid" if judge(r.body)[0] else "invalid"), 90, r.error, 0, 0) for r in rows]
    told = D.reduce_attempts(spark.createDataFrame(log, "doc_id string, page_index int, attempt int, outcome string, correction int, error string, prompt_tokens long, completion_tokens long"), 4)
    assert {(r.doc_id, r.status, r.attempts, r.applied_rotation) for r in told.collect()} == {("0", "valid", 3, 180), ("1", "failed", 1, 0), ("2", "failed", 4, 0), ("3", "valid", 1, 0)}


def test_nothing_stored_is_asked_twice(spark, tmp_path):
    log, store, broken = tmp_path / "log", f"{tmp_path}/store", tmp_path / "broken"
    log.mkdir()

    def answer(payload):
        if payload == "p15" and not broken.exists():
            broken.write_text("")
            raise RuntimeError("the task dies")
        return payload.upper()

    transport = recorder(log, answer)
    with pytest.raises(Exception, match="the task dies"):
        R.infer_pages(asked(spark, 30), transport, window=3, store=store).collect()
    kept = {name for name in os.listdir(store)}
    rows = R.infer_pages(asked(spark, 30), transport, window=3, store=store).collect()
    assert {(r.doc_id, r.body) for r in rows} == {(str(i), f"P{i}") for i in range(30)}
    times = [p for p, _ in seen(log)]
    assert kept and len(times) <= 30 + (30 - len(kept)) and len(os.listdir(store)) == 30
    R.infer_pages(asked(spark, 30), transport, store=store).collect()
    assert len(seen(log)) == len(times)


def test_coroutines_and_no_rows(spark):
    async def slow(payload):
        import asyncio

        await asyncio.sleep(0.001)
        return payload

    assert R.infer_pages(asked(spark, 5), slow).count() == 5
    assert R.infer_pages(asked(spark, 5).where("doc_id < 0"), slow).count() == 0
