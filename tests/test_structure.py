import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import procedural as P
from pagemill.functions import structure as S

PIECES = ["[", "]", "{", "}", '"', "\\", "1", ",", ":", '"a":', "[1]", "{}", " ", "x", '"s"', '"[2]"', "é🎉"]


def every_start(text):
    """By trying a parser at each bracket in turn."""
    for m in re.finditer(r"[\[{]", text):
        try:
            return True, json.JSONDecoder().raw_decode(text, m.start())[0]
        except ValueError:
            pass
    return False, None


def test_first_value():
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))
        assert S.first_value(text) == every_start(text), text


@pytest.mark.parametrize("text", ["[" * 100_000, "[" * 100_000 + "]" * 100_000, "[1," * 50_000, '{"a":' * 50_000 + "1" + "}" * 50_000, '["[",' * 50_000, "[x" * 50_000 + "]" * 50_000, '[1,2"' * 30_000])
def test_many_brackets(text):
    began = time.time()
    S.first_value(text), S.whole_value(text)
    P.normal_cells(text, True), P.normal_cells(text, False), P.svg_fragment(text)
    assert time.time() - began < 10


def test_depth():
    deep = lambda n: "[" * n + "1" + "]" * n
    assert S.whole_value(deep(S.DEPTH))[0] and not S.whole_value(deep(S.DEPTH + 1))[0]
    value, n = S.first_value("x" + deep(S.DEPTH + 5))[1], 0
    while isinstance(value, list):
        value, n = value[0], n + 1
    assert n == S.DEPTH
    assert S.whole_value('"' + "[" * 2000 + '"') == (True, "[" * 2000)


def test_cells_behind_brackets():
    cell = '{"bbox":[0,0,1,1],"category":"Text","text":"t"}'
    assert json.loads(P.normal_cells('{"data":{"result":{"cells":[' + cell + "]}}}", False))[0]["text"] == "t"
    assert json.loads(P.normal_cells("note [unclosed \"quote [" + cell + "]", False))[0]["text"] == "t"
    assert json.loads(P.normal_cells("```json\n[" + cell + "," + cell + ',{"bbox":[0,0', True)) == 2 * json.loads(P.normal_cells("[" + cell + "]", False))


def test_rows_are_read_one_by_one(spark):
    """Long responses don't meet in an Arrow batch of 10,000 rows, so a worker's memory doesn't grow with them."""
    rows = spark.range(40).select(F.format_string('[{"category":"Text","bbox":[0,0,1,1],"text":"%s"},{"bbox":[0', F.repeat(F.lit("é"), 100_000)).alias("t"))
    made = rows.select(P.recover_cells("t", F.lit(True)).alias("c"), P.recover_svg(F.concat(F.lit("<svg>"), "t")).alias("s"), P.convert_html("t").alias("h"))
    assert "Arrow" not in made._jdf.queryExecution().toString()
    assert made.where("length(c) > 100000 AND endswith(s, '</svg>') AND length(h.markdown) > 100000").count() == 40
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(P.recover_cells("t", F.lit(None).cast("boolean")), P.recover_svg("t"), P.convert_html("t").getField("markdown"))
    assert tuple(nothing.first()) == (None, None, "")


@pytest.mark.parametrize("name", ["recover_json", "parse_page_response"])
def test_queries_read_row_by_row(spark, name):
    from pagemill.plans import layouts

    made = layouts.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert "Arrow" not in made._jdf.queryExecution().toString()
