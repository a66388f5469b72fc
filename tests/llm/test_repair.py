import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from pagemill.llm import repair

VALID = re.compile(r"(s?(ua)+)?")
DDL = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """Least cost and its ASCII-least edits, by trying every edit of every row and up to two inserts in every gap."""
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product("DKua", repeat=len(codes)):
        cost, ok = 0, True
        for code, e in zip(codes, edits):
            fault = code // 4
            ok &= e == "D" or fault not in (repair.BLANK, repair.DUPLICATE)
            cost += {"D": 2, "K": 0, "u": 1, "a": 1}[e] + (5 if e != "D" and fault == repair.CUT else 0)
        if not ok:
            continue
        roles = ["" if e == "D" else "suax"[c % 4] if e == "K" else e for c, e in zip(codes, edits)]
        for filled in itertools.product(gaps, repeat=len(codes) + 1):
            total = cost + 5 * sum(map(len, filled))
            if best and total > best[0]:
                continue
            said = "".join("".join(g) + r for g, r in itertools.zip_longest(filled, roles, fillvalue=""))
            if VALID.fullmatch(said):
                audit = "".join("I" * len(g) + ("" if e is None else e if e in "DK" else "R") for g, e in itertools.zip_longest(filled, edits))
                best = min(best or (total, audit), (total, audit))
    return best


def test_every_way():
    for n in range(4):
        for codes in itertools.product(range(16), repeat=n) if n < 3 else [tuple(random.Random(k).choices(range(16), k=3)) for k in range(12)]:
            audit, cost, _ = repair.forward(bytes(codes), repair.backward(bytes(codes), repair.END), 0, True)
            assert (cost, audit) == cheapest(codes), codes


def talks(seed=5, n=60):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 4, 7, 30])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c, t, role, rng.choice([None, "", " \t", "Yes.", "No!\n", "what", "Really?  ", f"own {c} {t}.", f"own {t}", "日本。", "a.\x1c"])))
    out += [(None, t, ("user", "assistant")[t % 2], f"null {t}.") for t in range(9)] + [(99, None, "user", "no turn."), (99, 3, "assistant", "later."), (99, 3, "assistant", "later."), (99, 3, "user", "x" * 200_000 + "!")]
    out += [(100, None, "user", "a."), (100, None, "assistant", "b.")]
    dropped = next(c for c in range(200, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return out + [(dropped, 0, "user", "gone.")]


def by_sql(rows, spark, tmp_path):
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/sql/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/sql/conversations.parquet/*.parquet'")
    return sorted(con.execute(repair.OP12_SQL).fetchall(), key=str)


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_op12(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = talks()
    spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", position int, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, repair.op12_structure_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql(rows, spark, tmp_path)
    assert {r[0] for r in got} == {r[0] for r in rows}
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in {r[1:] for r in got}


def test_a_hot_conversation_in_chunks(spark):
    """A clean, long conversation that ends wrongly: what its end changes is carried through all chunks."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(401)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    made = repair.Repair(spark.createDataFrame(rows, DDL), chunk=50)
    told = {r.conv_id: r for r in made.report().collect()}
    assert told[2].audit == "KK"
    codes = bytes([1, 2] * 200 + [1])
    audit, cost, _ = repair.forward(codes, repair.backward(codes, repair.END), 0, True)
    assert (told[1].cost, told[1].audit) == (cost, audit)
    lines = made.repaired().orderBy("conv", "chunk", "line").collect()
    said = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines if r.conv == 0).encode()).hexdigest()
    assert said == {r.conv: r.repaired_sha256 for r in made.digests().collect()}[0]
    assert VALID.fullmatch("".join(r.role[0] for r in lines if r.conv == 0))


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    made = repair.Repair(repair.damage(none))
    assert made.report().count() == made.repaired().count() == made.digests().count() == 0
