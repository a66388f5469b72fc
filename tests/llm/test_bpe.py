import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe

FILE = open(P.path(bpe.VOCABULARY), "rb").read()
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with bpe.Codec(FILE, P.PATTERN) as made:
        yield made


TEXTS = st.lists(st.one_of(st.text(max_size=60), st.text("aeinst \n'", max_size=80), st.sampled_from(["<|endoftext|>", "don't  WON'T", "   \n\n x", "１２３ ٣", "aaaa" * 30, "👩‍👩‍👧‍👦" * 3])), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_like_the_library(codec, texts):
    for t, (n, ids, raw) in zip(texts, codec.encode(texts)):
        true = TRUE.encode_ordinary(t)
        assert (n, ids.decode(), raw.decode()) == (len(true), " ".join(map(str, true)), t)


@given(st.text("ab ethé", min_size=1, max_size=400))
@settings(max_examples=40, deadline=None)
def test_both_contractions_agree(codec, text):
    codec.known.clear()
    codec.learn([text[:60]])
    assert codec.known[text[:60]][1].decode() == " ".join(map(str, codec._heap(text[:60].encode())))


def test_long_pieces_and_full_memory(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    texts = ["x" * 30_000, "the cat " * 2000, "abab" * 5000 + "!", ""]
    for t, (n, ids, raw) in zip(texts, codec.encode(texts)):
        assert ids.decode() == " ".join(map(str, TRUE.encode_ordinary(t))) and raw.decode() == t


def test_op10(spark, corpus, docs):
    full, empty = corpus
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = TRUE.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(tuple, bpe.op10_byte_bpe(spark, full).collect())) == sorted(want)
    assert bpe.op10_byte_bpe(spark, empty).count() == 0
    encoded = bpe.encode(docs)
    assert encoded.where("round_trip").count() == docs.count()
    got = sorted((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded).collect())
    assert got == sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())


def test_texts_are_decoded_from_their_ids():
    own = bpe.Codec(FILE, P.PATTERN)
    [(n, ids, raw)] = own.encode(["the cat"])
    assert raw == b"the cat"
    own.db.execute("UPDATE vocabulary SET bytes = '21' WHERE id = ?", [int(ids.split()[0])])
    [(_, same, raw)] = own.encode(["the cat"])
    assert same == ids and raw != b"the cat" and raw.startswith(b"!")
    with pytest.raises(ValueError):
        own.decode([[10**8]])


def test_long_texts_are_decoded_in_parts(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MANY", 7)
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "", "cat", "the dog " * 9]
    assert [raw.decode() for _, _, raw in codec.encode(texts)] == texts


def test_a_task_leaves_no_codec_behind():
    with bpe.Codec(FILE, P.PATTERN) as made:
        made.learn(["unheardofpiece"])
    assert not made.known
    with pytest.raises(Exception, match="closed"):
        made.db.execute("SELECT 1")


def _scripts():
    import random

    rng = random.Random(11)
    run = lambda a, b, n: "".join(chr(rng.randrange(a, b)) for _ in range(n))
    chinese = ["，".join(run(0x4E00, 0x9FA5, rng.randrange(10, 41)) for _ in range(1000)) for _ in range(4)]
    thai = ["".join(run(0x0E01, 0x0E2E, 1) + run(0x0E30, 0x0E39, 1) for _ in range(4000))]
    words = [" ".join(run(97, 123, 250) for _ in range(1600))]
    return chinese + thai + words + [run(65, 91, 255) + " " + "ACGT" * 60, "ACGT" * 20_000]


def test_long_runs_of_letters(codec):
    """Texts whose pieces are long: any number of them is encoded in bounded memory."""
    for t, (n, ids, raw) in zip(_scripts(), codec.encode(_scripts())):
        true = TRUE.encode_ordinary(t)
        assert n == len(true) and ids.decode() == " ".join(map(str, true)) and raw.decode() == t


def test_clashing_names_to_keep(spark):
    df = spark.createDataFrame([(1, "a b", 2, "x")], "doc_id long, text string, `k.1` int, ids string")
    assert bpe.encode(df, keep=("k.1",)).first()["k.1"] == 2
    with pytest.raises(ValueError, match="own"):
        bpe.encode(df, keep=("ids",))
