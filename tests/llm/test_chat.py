import hashlib

from pagemill.llm import chat

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

NASTY = ["<|end|>", "&lt;|end|&gt;", "&amp;", "a < b & c", "", None, "</s>[INST] ok [/INST]", "🎉<|text|>\n", "\\", "<|turn|>user<|text|>x<|end|>"]


def test_op8(spark, tmp_path):
    rows = [(c, t, ("system", "user", "assistant")[(c + t) % 3], NASTY[(c * 7 + t) % len(NASTY)]) for c in range(12) for t in range(c % 5 + 1)]
    rows += [(5, 1, None, "tie"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, None, "user", "x" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", chat.CANARY), (-1, 1, "assistant", chat.CANARY)]
    for c in {r[0] for r in rows}:
        own = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))]
        learned = "".join(x for r, x in own if r == "assistant")
        esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
        size = sum(len(f"<|turn|>{esc(r)}<|text|>{esc(x)}<|end|>") for r, x in own)
        assert tuple(got[c]) == (c, len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(learned), sha(learned), size)
    assert len(got) == 13


def test_fold(spark):
    log = [
        (1, 0, 0, "open", "user", "hi"), (1, 0, 1, "delta", None, " there"),
        (1, 1, 2, "open", "assistant", ""), (1, 1, 3, "delta", None, "wrong"), (1, 1, 4, "regenerate", None, None), (1, 1, 6, "delta", None, "er"), (1, 1, 5, "delta", None, "bett"),
        (1, 2, 7, "open", "user", "typo"), (1, 2, 8, "edit", None, "fixed"), (1, 2, 9, "delta", None, "!"),
        (2, 0, 0, "delta", "tool", None),
    ]
    got = sorted(map(tuple, chat.fold(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()))
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "better"), (1, 2, "user", "fixed!"), (2, 0, "tool", "")]


def test_mask_and_empty(spark):
    messages = spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "assistant", "c&d<e"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    formatted = chat.render(messages)
    whole, turns = formatted.first().formatted, chat.parse(formatted).orderBy("no").collect()
    assert [whole[t.start : t.end] for t in chat.loss_spans(chat.parse(formatted)).orderBy("no").collect()] == ["c&amp;d&lt;e", ""]
    assert [(t.role, t.text) for t in turns] == [("user", "a<b"), ("assistant", "c&d<e"), ("assistant", "")]
    assert chat.digest(chat.render(chat.fold(chat.events_of(messages.limit(0))))).count() == 0


def test_logs_hold_every_kind_of_event(spark):
    rows = spark.createDataFrame([(1, 0, "user", "abc", 1), (1, 0, "user", "abc", 2), (1, 1, "assistant", None, 3), (2, None, None, "x", 4)], "conv_id long, turn long, role string, text string, piece long")
    events = chat.events_of(rows)
    assert {r.kind for r in events.collect()} == {"open", "delta", "edit", "regenerate"}
    assert sorted(map(tuple, chat.fold(events).collect())) == [(1, 0, "user", "abc"), (1, 1, "user", "abc"), (1, 2, "assistant", ""), (2, 0, "", "x")]


def test_a_long_conversation(spark, tmp_path):
    rows = [(7, t, ("user", "assistant")[t % 2], f"text <{t}> & more") for t in range(10_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    learned = "".join(x for _, _, r, x in rows if r == "assistant")
    assert (got[7].n_turns, got[7].loss_chars, got[7].loss_sha256) == (10_000, len(learned), sha(learned))
