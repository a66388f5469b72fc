from collections import Counter
from fractions import Fraction
from itertools import islice

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import mixing


@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.floats(0.01, 100), min_size=1, max_size=12))
@settings(max_examples=50, deadline=None)
def test_every_prefix_is_within_a_block(weights):
    shares = mixing.units(weights, 200)
    assert sum(shares.values()) == 200 and min(shares.values()) >= 1
    seen = Counter()
    for t, s in enumerate(mixing.period(shares), 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * n / 200) < 1 for x, n in shares.items())
    assert seen == Counter(shares)


def test_phases_place_each_block_once():
    blocks = {"a": 70, "b": 5, "c": 200, "d": 1}
    spans, cycles = mixing.phases(blocks, {"a": 1, "b": 2, "c": 3, "d": 0.1}, 100)
    at = {(s, p, j): x for s, p, j, x in cycles}
    slots = []
    for s, n in blocks.items():
        for b in range(n):
            ((p, first, slot, period, units),) = [(p, f, sl, pe, u) for q, p, f, ln, sl, pe, u in spans if q == s and f <= b < f + ln]
            slots.append(slot + (b - first) // units * period + at[s, p, (b - first) % units])
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_mix(spark, docs):
    out = mixing.mix(docs, {"a": 3, "b": 1}, block_rows=1, group_rows=2).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == {*docs.columns, "mix_rank", "mix_block", "mix_slot", "mix_position"}
    assert sorted(r.mix_position for r in out) == list(range(len(out)))
    for s in ("a", "b", "c", None):
        own = sorted(r.mix_rank for r in out if r.source == s)
        assert own == list(range(len(own)))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, mixing.mixed_order(docs).collect())) == sorted(map(str, docs.collect()))


def test_deviation_at_scale(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 17 END) AS source")
    weights = {f"s{i}": 1 + i for i in range(17)}
    rows = mixing.mix(df, weights, block_rows=10).orderBy("mix_slot").select("source", "mix_slot", "mix_block").distinct().orderBy("mix_slot").collect()
    assert [r.mix_slot for r in rows] == list(range(len(rows)))
    sizes = Counter(r.source for r in rows)
    shares, seen = mixing.units({k: weights[k] for k in sizes}), Counter()
    for t, r in enumerate(rows, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * n / 1000) < 1 for s, n in shares.items())
        if any(seen[s] == sizes[s] for s in sizes):  # the first source has run out: another phase
            break
    assert t > 100


@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.floats(0.001, 1000), min_size=1, max_size=12))
@settings(max_examples=30, deadline=None)
def test_schedule_stays_within_a_block_of_the_target_weights(weights):
    total, seen = sum(map(Fraction, weights.values())), Counter()
    for t, (s, block) in enumerate(islice(mixing.schedule(dict.fromkeys(weights, 10**9), weights), 5000), 1):
        assert block == seen[s]
        seen[s] += 1
        if t % 7 == 0 or t > 4900:
            assert all(abs(seen[x] - t * Fraction(w) / total) < 1 for x, w in weights.items())


def test_op1_follows_the_target_weights(spark, tmp_path):
    # One hot source beside 1,200 of one row each: more than the resolution, and far from whole thousandths.
    df = spark.range(91_200).selectExpr("id AS doc_id", "concat('s', greatest(id - 89999, 0)) AS source")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op1_mix_sources(spark, str(tmp_path)).select("source", "mix_block", "mix_slot").distinct().orderBy("mix_slot").collect()
    assert [r.mix_slot for r in rows] == list(range(1407 + 1200))
    assert all(r.mix_block == 0 for r in rows if r.source != "s0")
    share = 300 / 1500
    hot = 0
    for t, r in enumerate(rows, 1):
        hot += r.source == "s0"
        if r.source != "s0":  # the first small source has run out: another phase
            break
        assert abs(hot - t * share) < 1
    assert sorted(r.mix_block for r in rows if r.source == "s0") == list(range(1407))


def test_three_equal_sources(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    rows = mixing.mix(df, block_rows=5, resolution=None).select("source", "mix_slot").distinct().orderBy("mix_slot").collect()
    seen = Counter()
    for t, r in enumerate(rows, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t / 3) < 1 for s in ("s0", "s1", "s2"))
    assert t == 12_000


def test_op1_like_a_simulation(spark, tmp_path):
    """The query against the schedule worked out block by block, by its definition."""
    from fractions import Fraction

    rows = [(i, ("a", "b", None, "rare")[0 if i % 3 else 1 + i // 3 % 3], "x") for i in range(3000)] + [(5, "a", "again")]
    spark.createDataFrame(rows, "doc_id long, source string, g string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    count = {}
    for _, s, _ in rows:
        count[s] = count.get(s, 0) + 1
    left = {s: -(-n // mixing.BLOCK_ROWS) for s, n in count.items()}
    done, order = dict.fromkeys(left, 0), []
    while any(left[s] > done[s] for s in left):
        open_ = {s: Fraction(count[s] ** 0.5) for s in left if left[s] > done[s]}
        first, t, total = dict(done), 0, sum(open_.values())
        share = {s: w / total for s, w in open_.items()}
        while all(left[s] > done[s] for s in open_):
            released = [s for s in open_ if (done[s] - first[s]) / share[s] < t + 1 and int((done[s] - first[s]) / share[s]) <= t]
            s = min(released, key=lambda s: (-(-(done[s] - first[s] + 1) // share[s]), "null" if s is None else f"={s}"))
            order.append((s, done[s]))
            done[s] += 1
            t += 1
    assert sorted({(r.mix_slot, r.source, r.mix_block) for r in got}) == [(i, *x) for i, x in enumerate(order)]
    for s in count:
        assert sorted(r.mix_rank for r in got if r.source == s) == list(range(count[s]))
    assert all(r.mix_position == r.mix_slot * mixing.BLOCK_ROWS + r.mix_rank % mixing.BLOCK_ROWS and r.mix_block == r.mix_rank // mixing.BLOCK_ROWS for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string"), resolution=None).count() == 0


def test_exact_weights_over_a_million_blocks():
    weights = {"a": 1.0, "b": 0.3, "c": 0.01, "d": 1e-5}
    total, got, worst = sum(weights.values()), dict.fromkeys(weights, 0), 0.0
    for t, (s, _) in enumerate(mixing.schedule(dict.fromkeys(weights, 10**6), weights), 1):
        got[s] += 1
        if t % 997 == 0:
            worst = max(worst, *(abs(got[x] - t * w / total) for x, w in weights.items()))
        if t == 10**6:
            break
    assert worst < 1


def test_columns_of_any_name(spark):
    names = ("s", "h", "g", "i", "o", "row", "key", "a.b")
    df = spark.createDataFrame([(1, "x", *names), (2, None, *names)], f"doc_id long, source string, {', '.join(f'`{c}` string' for c in names)}")
    for resolution in (None, 1000):
        assert sorted(tuple(r)[:-4] for r in mixing.mix(df, resolution=resolution).collect()) == sorted(map(tuple, df.collect()))
