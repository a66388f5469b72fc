"""Queries over plans, profiles, geometry, requests and placed images, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import chat, images, sizes
from ..operators import planning as Pl
from ..sources import profiles


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


RANGE_IN = "SELECT o_orderkey, CAST(o_orderkey % 10 AS INT) AS total, CAST(o_custkey % 12 - 1 AS INT) AS start_page, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 11 - 1 AS INT) END AS end_page FROM orders"


def page_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").selectExpr("o_orderkey", "int(o_orderkey % 10) AS total", "int(o_custkey % 12 - 1) AS start_page", "IF(o_orderkey % 3 = 0, int(o_custkey % 11 - 1), NULL) AS end_page")
    last, wrong = Pl.page_range(F.col("total"), F.col("start_page"), F.col("end_page"))
    checked = rows.select("o_orderkey", "start_page", last.alias("end_page"), wrong.alias("error"))
    tasks = Pl.page_tasks(checked).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("page_index").alias("page_sum"))
    return checked.join(tasks, "o_orderkey", "left").select("o_orderkey", "error", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("page_sum", F.lit(0)).alias("page_sum"))


RANGE = f"""WITH r AS ({RANGE_IN}), e AS (SELECT o_orderkey, total, start_page, coalesce(end_page, total - 1) AS end_page FROM r),
x AS (SELECT *, CASE WHEN total <= 0 THEN 'no pages' WHEN start_page < 0 THEN 'negative start' WHEN end_page < 0 THEN 'negative end' WHEN start_page > end_page THEN 'start after end' WHEN start_page >= total THEN 'start out of bounds' WHEN end_page >= total THEN 'end out of bounds' END AS error FROM e)
SELECT o_orderkey, error, CAST(CASE WHEN error IS NULL THEN end_page - start_page + 1 ELSE 0 END AS BIGINT) AS n_pages, CAST(CASE WHEN error IS NULL THEN (end_page - start_page + 1) * (start_page + end_page) // 2 ELSE 0 END AS BIGINT) AS page_sum FROM x"""

SPEC = "CASE c_custkey % 9 WHEN 0 THEN '3,1-2,2-' WHEN 1 THEN '-' || (c_custkey % 5 + 1) WHEN 2 THEN (c_custkey % 4) || '-' || (c_custkey % 6) WHEN 3 THEN ' 2 , ,1' WHEN 4 THEN '-' WHEN 5 THEN ' , ' WHEN 6 THEN 'a,1' WHEN 7 THEN (c_custkey % 7) || '-' ELSE '1,9,x' END"


def page_selector(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select("c_custkey", F.expr(SPEC).alias("spec"), F.expr("int(c_custkey % 6)").alias("total_pages"), F.expr("c_custkey % 2 = 0").alias("zero_based"))
    return Pl.select_pages(rows).select("c_custkey", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "error")


SELECTOR = f"""WITH s AS (SELECT c_custkey, {SPEC} AS spec, CAST(c_custkey % 6 AS INT) AS total, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS low FROM customer),
k AS (SELECT *, total - 1 + low AS high, unnest(string_split(spec, ',')) AS t, unnest(range(len(string_split(spec, ',')))) AS i FROM s), t AS (SELECT * REPLACE (trim(t) AS t) FROM k WHERE trim(t) <> ''),
p AS (SELECT *, contains(t, '-') AS r, trim(split_part(t, '-', 1)) AS a, trim(split_part(t, '-', 2)) AS b FROM t),
v AS (SELECT *, CASE WHEN r AND a = '' THEN low ELSE TRY_CAST(a AS INT) END AS x, CASE WHEN NOT r THEN TRY_CAST(a AS INT) WHEN b = '' THEN high ELSE TRY_CAST(b AS INT) END AS y FROM p),
e AS (SELECT *, CASE WHEN r AND a = '' AND b = '' THEN 'empty range' WHEN x IS NULL OR y IS NULL THEN 'not a number' WHEN x > y THEN 'start after end' WHEN x < low OR y > high THEN 'out of bounds' END AS bad FROM v),
w AS (SELECT c_custkey, arg_min(bad, i) FILTER (bad IS NOT NULL) AS bad, count(*) AS n FROM e GROUP BY c_custkey),
q AS (SELECT c_custkey, pg - low AS pg, min(i * 1000 + pg) AS first FROM (SELECT c_custkey, low, i, unnest(generate_series(x, y)) AS pg FROM e WHERE bad IS NULL) GROUP BY ALL),
l AS (SELECT c_custkey, string_agg(CAST(pg AS VARCHAR), ',' ORDER BY first) AS pages FROM q GROUP BY c_custkey)
SELECT s.c_custkey, CASE WHEN total > 0 AND n > 0 AND bad IS NULL THEN pages END AS pages, CASE WHEN total <= 0 THEN 'no pages' WHEN n IS NULL THEN 'no selectors' ELSE bad END AS error FROM s LEFT JOIN w USING (c_custkey) LEFT JOIN l USING (c_custkey)"""

PATH = "'in/' || (page_id % 5) || '/F' || (page_id % 61) || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", F.expr(PATH).alias("path")).groupBy("path").agg(F.min("page_id").alias("page_id"))


FILES = f"f AS (SELECT DISTINCT {PATH} AS path FROM pages), n AS (SELECT path, 'md/' || regexp_extract(path, '([^/]*)\\.[^.]*\\z', 1) || '.md' AS output FROM f)"


def output_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return Pl.collisions(_files(spark, sf))


COLLISIONS = f"WITH {FILES}, o AS (SELECT output, first_value(path) OVER w AS first_path, path, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY output ORDER BY lower(path), path)) SELECT output, first_path, path FROM o WHERE k > 1"


def collision_report(spark: SparkSession, sf: str) -> DataFrame:
    return Pl.collision_report(_files(spark, sf))


REPORT = f"WITH {FILES}, o AS (SELECT output, first_value(path) OVER w AS first_path, path, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY output ORDER BY lower(path), path)), c AS (SELECT *, row_number() OVER (ORDER BY output, path) AS j FROM o WHERE k > 1) SELECT output || ' ' || first_path || ' ' || path AS line FROM c WHERE j <= 10 UNION ALL SELECT '... and ' || (count(*) - 10) || ' more' FROM c HAVING count(*) > 10"


def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    done = _t(spark, sf, "pages").where("page_id % 61 % 3 = 0").select(F.expr("concat('md/F', page_id % 61, '.md')").alias("output")).distinct()
    return Pl.plan(_files(spark, sf), done)


def skip_existing_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """As ``skip_existing``, with the history in a bucketed table of its own."""
    import uuid

    from ..sources import history

    table = f"history_{uuid.uuid4().hex}"
    done = _t(spark, sf, "pages").where("page_id % 61 % 3 = 0").select(F.expr("concat('md/F', page_id % 61, '.md')").alias("output")).distinct()
    history.save(done, table)
    return history.plan(_files(spark, sf), table)


SKIP = f"WITH {FILES} SELECT path, output FROM n WHERE output NOT IN (SELECT 'md/F' || (page_id % 61) || '.md' FROM pages WHERE page_id % 61 % 3 = 0)"


def page_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders")
    return rows.select("o_orderkey", T.page_name(F.col("o_orderkey") * 7, F.lit(120000)).alias("name"), T.page_name(F.col("o_custkey") % 1000, F.lit(999)).alias("short"))


NAMES = "SELECT o_orderkey, 'p' || lpad(CAST(o_orderkey * 7 AS VARCHAR), greatest(6, length(CAST(o_orderkey * 7 AS VARCHAR)))::INT, '0') AS name, 'p' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS short FROM orders"

SERVICE = "CASE event_id % 6 WHEN 0 THEN 'GLM-OCR/' WHEN 1 THEN ' dots.ocr ' WHEN 2 THEN 'rednote-hilab/dots.ocr' WHEN 3 THEN 'nope/' WHEN 4 THEN 'CHANDRA' ELSE 'Baidu/Unlimited-OCR' END"


def resolve_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "events").select("event_id", F.expr(SERVICE).alias("service"))
    return profiles.with_profile(rows).select("event_id", "canonical", "model", "parser", F.coalesce("max_tokens", F.lit(0)).alias("max_tokens"), "token_param", "profile", F.col("error").isNotNull().alias("unknown"))


PROFILE = f"""WITH s AS (SELECT event_id, event_id % 6 AS k FROM events), v(k, canonical, model, parser, max_tokens, token_param, profile) AS (VALUES
  (0, 'zai-org/GLM-OCR', 'zai-org/GLM-OCR', 'markdown', 16384, 'max_tokens', 'GLM'), (1, 'rednote-hilab/dots.ocr-1.5', 'rednote-hilab/dots.ocr-1.5', 'dots_layout_json', 32768, 'max_completion_tokens', 'DOTS'),
  (2, 'rednote-hilab/dots.ocr', 'rednote-hilab/dots.ocr', 'dots_layout_json', 32768, 'max_completion_tokens', 'DOTS'), (3, 'nope', NULL, NULL, NULL, NULL, NULL),
  (4, 'datalab-to/chandra-ocr-2', 'datalab-to/chandra-ocr-2', 'chandra_html', 12384, 'max_tokens', 'CHANDRA'), (5, 'baidu/Unlimited-OCR', 'Unlimited-OCR', 'unlimited_ocr', 4096, 'max_tokens', 'UNLIMITED'))
SELECT event_id, canonical, model, parser, CAST(coalesce(max_tokens, 0) AS BIGINT) AS max_tokens, token_param, profile, model IS NULL AS unknown FROM s JOIN v USING (k)"""


def accepted_finish(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.expr("CASE event_type WHEN 'view' THEN 'stop' WHEN 'click' THEN 'length' WHEN 'error' THEN 'content_filter' WHEN 'signup' THEN 'end_turn' END")
    rows = profiles.with_profile(_t(spark, sf, "events").select("event_id", reason.alias("reason"), F.expr(SERVICE).alias("service")))
    return rows.where("error IS NULL").groupBy("canonical", "reason").agg(F.count_if(profiles.accepts(F.col("reason"), F.col("accepted"))).alias("accepted"), F.count(F.lit(1)).alias("n"))


FINISH = """WITH r AS (SELECT CASE event_id % 6 WHEN 0 THEN 'zai-org/GLM-OCR' WHEN 1 THEN 'rednote-hilab/dots.ocr-1.5' WHEN 2 THEN 'rednote-hilab/dots.ocr' WHEN 4 THEN 'datalab-to/chandra-ocr-2' ELSE 'baidu/Unlimited-OCR' END AS canonical,
  CASE event_type WHEN 'view' THEN 'stop' WHEN 'click' THEN 'length' WHEN 'error' THEN 'content_filter' WHEN 'signup' THEN 'end_turn' END AS reason FROM events WHERE event_id % 6 <> 3)
SELECT canonical, reason, count(*) FILTER (reason IS NULL OR reason IN ('stop', 'end_turn') OR (reason = 'length' AND canonical = 'baidu/Unlimited-OCR')) AS accepted, count(*) AS n FROM r GROUP BY ALL"""


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", F.expr("double(p_size * 40 + p_partkey % 97)").alias("w"), F.expr("double(p_partkey % 1500 + 5)").alias("h")).join(F.broadcast(profiles.render_profiles(spark)))


def render_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sizes(spark, sf)
    return rows.select("p_partkey", "profile", G.render_scale(F.col("w"), F.col("h"), {c: F.col(c) for c in rows.columns}).alias("scale"))


_R = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r[:9]) + ")" for r in profiles.RENDER)
RENDERS = f"r(profile, dpi, target, cap, least_side, f, least, most, n) AS (VALUES {_R})"
SCALE = f"""WITH {RENDERS}, s AS (SELECT p_partkey, CAST(p_size * 40 + p_partkey % 97 AS DOUBLE) AS w, CAST(p_partkey % 1500 + 5 AS DOUBLE) AS h FROM part),
a AS (SELECT *, greatest(w, h) AS lo, least(w, h) AS sh, coalesce(CAST(dpi AS DOUBLE) / 72.0, target / greatest(w, h)) AS base FROM s CROSS JOIN r), b AS (SELECT *, CASE WHEN sh * base < least_side THEN least_side / sh ELSE base END AS raised FROM a)
SELECT p_partkey, profile, CASE WHEN lo * raised > cap THEN cap / lo ELSE raised END AS scale FROM b"""


def smart_resize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sizes(spark, sf).where("strategy = 'smart'")
    size = G.smart_size(F.col("w"), F.col("h"), {c: F.col(c) for c in rows.columns})
    return rows.select("p_partkey", "profile", size.alias("s")).select("p_partkey", "profile", "s.width", "s.height")


SMART = f"""WITH {RENDERS}, s AS (SELECT p_partkey, CAST(p_size * 40 + p_partkey % 97 AS DOUBLE) AS w, CAST(p_partkey % 1500 + 5 AS DOUBLE) AS h FROM part),
a AS (SELECT *, greatest(f, CAST(round_even(w / f, 0) AS BIGINT) * f) AS w1, greatest(f, CAST(round_even(h / f, 0) AS BIGINT) * f) AS h1 FROM s CROSS JOIN r WHERE profile <> 'CHANDRA'),
b AS (SELECT *, sqrt(n * w * h / CAST(most AS DOUBLE)) AS shrink, sqrt(CAST(least AS DOUBLE) / (n * w * h)) AS grow FROM a)
SELECT p_partkey, profile,
  CAST(CASE WHEN f IS NULL THEN w WHEN n * w1 * h1 > most THEN greatest(f, floor(w / shrink / f) * f) WHEN n * w1 * h1 < least THEN ceil(w * grow / f) * f ELSE w1 END AS BIGINT) AS width,
  CAST(CASE WHEN f IS NULL THEN h WHEN n * w1 * h1 > most THEN greatest(f, floor(h / shrink / f) * f) WHEN n * w1 * h1 < least THEN ceil(h * grow / f) * f ELSE h1 END AS BIGINT) AS height FROM b"""


def block_resize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sizes(spark, sf).where("strategy = 'blocks'").select("p_partkey", "w", "h", F.col("resize_factor").alias("factor"), F.col("min_pixels").alias("least"), F.col("max_pixels").alias("most"))
    return sizes.block_sizes(rows).select("p_partkey", "width", "height")


BLOCKS = """WITH RECURSIVE s AS (SELECT p_partkey, CAST(p_size * 40 + p_partkey % 97 AS DOUBLE) AS w, CAST(p_partkey % 1500 + 5 AS DOUBLE) AS h FROM part),
a AS (SELECT *, CASE WHEN w * h > 6291456 THEN sqrt(6291456 / (w * h)) WHEN w * h < 50176 THEN sqrt(50176 / (w * h)) ELSE 1.0 END AS k FROM s),
l(p_partkey, aspect, x, y) AS (SELECT p_partkey, w / h, greatest(1, CAST(round_even(w * k / 28, 0) AS BIGINT)), greatest(1, CAST(round_even(h * k / 28, 0) AS BIGINT)) FROM a
  UNION ALL SELECT p_partkey, aspect, CASE WHEN n THEN x - 1 ELSE x END, CASE WHEN n THEN y ELSE y - 1 END
  FROM (SELECT *, x > 1 AND (y = 1 OR abs((x - 1) / CAST(y AS DOUBLE) - aspect) < abs(x / CAST(y - 1 AS DOUBLE) - aspect)) AS n FROM l WHERE x * y * 784 > 6291456 AND (x > 1 OR y > 1)))
SELECT p_partkey, CAST(arg_min(x, x * y) * 28 AS INTEGER) AS width, CAST(arg_min(y, x * y) * 28 AS INTEGER) AS height FROM l GROUP BY p_partkey"""


def resize_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every size by every profile, each with its own strategy."""
    return sizes.resize(_sizes(spark, sf)).select("p_partkey", "profile", "width", "height")


RESIZE = f"""SELECT * FROM ({SMART}) UNION ALL SELECT p_partkey, 'CHANDRA' AS profile, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM ({BLOCKS})"""


def source_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents")
    known = Pl.source_metadata(rows, "doc_id", title=F.when(F.col("doc_id") % 3 > 0, F.col("source")), lang=F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise(""), pages=F.col("n_chars") % 7)
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return known.select("doc_id", F.array_join(entries, ";").alias("metadata"))


METADATA = "SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 4 > 0 AND lang <> '' THEN 'lang=' || lang END, 'pages=' || (n_chars % 7), CASE WHEN doc_id % 3 > 0 AND source <> '' THEN 'title=' || source END) AS metadata FROM documents"


def service_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by service, with what the service's model is asked and the lines that a listing shows."""
    asked = profiles.with_profile(_t(spark, sf, "events").select("event_id", F.expr(SERVICE).alias("service"))).where("error IS NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("requests"), F.first("prompt").alias("prompt"))
    return asked.join(F.broadcast(profiles.listing(spark)), F.col("canonical") == F.col("name")).select("canonical", "requests", F.sha2("prompt", 256).alias("prompt_sha256"), "lines")


_P = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in (m[0], profiles.OF_MODEL[m[0]], f"{m[0]} (model {m[1]})\n  parser {m[2]}, render profile {m[12]}, at most {m[3]} tokens")) + ")" for m in profiles.MODELS)
PROMPTS = f"""WITH m(canonical, prompt, lines) AS (VALUES {_P}), e AS (SELECT CASE event_id % 6 WHEN 0 THEN 'zai-org/GLM-OCR' WHEN 1 THEN 'rednote-hilab/dots.ocr-1.5' WHEN 2 THEN 'rednote-hilab/dots.ocr' WHEN 4 THEN 'datalab-to/chandra-ocr-2' ELSE 'baidu/Unlimited-OCR' END AS canonical FROM events WHERE event_id % 6 <> 3)
SELECT canonical, count(*) AS requests, sha256(any_value(prompt)) AS prompt_sha256, any_value(lines) AS lines FROM e JOIN m USING (canonical) GROUP BY canonical"""


def chat_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The request of each turn, read back field by field."""
    rows = _t(spark, sf, "conversations").withColumn("service", F.expr("CASE conv_id % 4 WHEN 0 THEN 'glm-ocr' WHEN 1 THEN 'dots.ocr' WHEN 2 THEN 'unlimited-ocr' ELSE 'deepseek-ocr' END"))
    rows = profiles.with_profile(rows)
    said = T.prompt(F.concat(F.lit("{width}x{height} "), "text"), F.lit(616), F.lit(784), F.lit(""))
    body = F.parse_json(chat.payload(said, T.data_uri(F.lit("image/png"), F.encode("text", "utf-8")), {c: F.col(c) for c in rows.columns}))
    get = lambda path, kind="string": F.try_variant_get("b", path, kind) if kind == "string" else F.coalesce(F.try_variant_get("b", path, kind), F.lit(0))
    first, second = "$.messages[0].content[0]", "$.messages[0].content[1]"
    text = F.coalesce(get(first + ".text"), get(second + ".text"))
    return rows.select("conv_id", "turn", body.alias("b")).select(
        "conv_id", "turn", get("$.model").alias("model"), get("$.max_tokens", "long").alias("max_tokens"), get("$.max_completion_tokens", "long").alias("max_completion_tokens"), get("$.top_k", "long").alias("top_k"),
        get(first + ".type").alias("first_type"), text.alias("text"), F.coalesce(get(first + ".image_url.url"), get(second + ".image_url.url")).alias("url"), get("$.dry_allowed_length", "long").alias("extra"),
    )


PAYLOAD = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'zai-org/GLM-OCR' WHEN 1 THEN 'rednote-hilab/dots.ocr-1.5' WHEN 2 THEN 'Unlimited-OCR' ELSE 'deepseek-ai/DeepSeek-OCR' END AS model,
  CAST(CASE conv_id % 4 WHEN 0 THEN 16384 WHEN 2 THEN 4096 WHEN 3 THEN 8192 ELSE 0 END AS BIGINT) AS max_tokens, CAST(CASE conv_id % 4 WHEN 1 THEN 32768 ELSE 0 END AS BIGINT) AS max_completion_tokens, CAST(CASE conv_id % 4 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS top_k,
  CASE conv_id % 4 WHEN 2 THEN 'text' ELSE 'image_url' END AS first_type, CASE conv_id % 4 WHEN 1 THEN '<|img|><|imgpad|><|endofimg|>' WHEN 3 THEN '<|grounding|>' ELSE '' END || '616x784 ' || text AS text,
  'data:image/png;base64,' || to_base64(encode(text)) AS url, CAST(CASE conv_id % 4 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS extra FROM conversations"""


def validate_response(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that hold a turn, some of them broken in one way each."""
    text = F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)
    content = F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},{"type":"x"},{"text":{"value":" end"}}]')))
    usual = F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit('},"finish_reason":"stop"}],"usage":{"prompt_tokens":'), F.length("text").cast("string"), F.lit("}}"))
    body = F.when(F.col("conv_id") % 8 == 0, '{"choices":[]}').when(F.col("conv_id") % 8 == 1, '{"choices":[{"message":null}]}').when(F.col("conv_id") % 8 == 2, '{"choices":[{"message":{"content":7}}]}').when(
        F.col("conv_id") % 8 == 3, '{"choices":[{"message":{"content":" "},"finish_reason":"stop"}]}').when(F.col("conv_id") % 8 == 4, F.replace(usual, F.lit('"stop"'), F.lit('"length"'))).when(F.col("conv_id") % 8 == 5, '{"choices":[7]}').otherwise(usual)
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    out = chat.validate(rows, F.array(*map(F.lit, profiles.STOP)))
    return out.select("conv_id", "turn", "error_kind", "retryable", F.when(F.col("error_kind").isNull(), F.col("text")).alias("text"), "prompt_tokens", "completion_tokens")


VALIDATE = """WITH r AS (SELECT *, conv_id % 8 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'choices missing' WHEN 1 THEN 'message missing' WHEN 2 THEN 'content type' WHEN 3 THEN 'content empty' WHEN 4 THEN 'finish reason' WHEN 5 THEN 'choice invalid' END AS error_kind,
  CASE WHEN k < 6 THEN k <> 4 END AS retryable, CASE WHEN k > 5 THEN text || CASE WHEN turn % 2 = 0 THEN '' ELSE ' end' END END AS text,
  CAST(CASE WHEN k IN (4, 6, 7) THEN length(text) ELSE 0 END AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens FROM r"""


def hub_model_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Through saved pages of the listing, of which only those that can hold such models are read."""
    from ..sources import hub
    from ..sources.places import shared_folder

    rows = _t(spark, sf, "part").select(F.col("p_name").alias("id"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")).alias("createdAt"), F.when(F.col("p_size") > 5, F.col("p_size") * 100).cast("long").alias("downloads"), (F.col("p_partkey") % 100).alias("likes"))
    folder = shared_folder(spark, "listing")
    hub.save_pages(rows, folder)
    return hub.filter_models(hub.read_pages(spark, folder), 1000, 50)


HUB = "SELECT p_name AS model_id, '2024-01-01T00:00:' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS created_at, CAST(p_size * 100 AS BIGINT) AS downloads, p_partkey % 100 AS likes, 'https://huggingface.co/' || p_name AS url FROM part WHERE p_size >= 10 AND p_partkey % 100 >= 50"


def _placements(spark: SparkSession, sf: str) -> DataFrame:
    """The events of a user, on three pages."""
    return _t(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("page_index"), F.col("event_id").alias("listing_pos"), (F.col("event_id") % 4).cast("int").alias("xref"),
        F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("digest"), *(F.expr(f"double(event_id % {m} + {p})").alias(c) for c, m, p in (("x0", 5, 0), ("y0", 7, 0), ("x1", 5, 100), ("y1", 7, 50))),
        (F.col("event_id") % 70).cast("int").alias("width"), F.when(F.col("event_id") % 9 > 0, F.lit(40)).alias("height"),
    )


PLACES = """p AS (SELECT user_id AS doc_id, event_id % 3 AS page_index, event_id AS listing_pos, CAST(event_id % 4 AS INTEGER) AS xref, CASE WHEN event_id % 5 > 0 THEN event_type END AS digest,
  event_id % 5 AS x0, event_id % 7 AS y0, event_id % 70 AS width, CASE WHEN event_id % 9 > 0 THEN 40 END AS height FROM events), f AS (SELECT * FROM p WHERE coalesce(width, 0) >= 32 AND coalesce(height, 0) >= 32)"""


def image_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    placed = images.large_enough(_placements(spark, sf))
    listed = _placements(spark, sf).select("doc_id", "page_index", "xref", "listing_pos", (F.col("listing_pos") * 10).alias("smask"))
    return images.reading_order(images.with_masks(placed, listed)).select("doc_id", "page_index", "listing_pos", "smask", "image_index")


READING = f"""WITH {PLACES}, m AS (SELECT doc_id, page_index, xref, arg_max(listing_pos * 10, listing_pos) AS smask FROM p WHERE xref > 0 GROUP BY ALL)
SELECT doc_id, page_index, listing_pos, coalesce(smask, 0) AS smask, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, listing_pos) AS INTEGER) AS image_index FROM f LEFT JOIN m USING (doc_id, page_index, xref)"""


def image_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return images.distinct_images(images.large_enough(_placements(spark, sf))).select("doc_id", "page_index", "listing_pos", "image_index")


DEDUP = f"""WITH RECURSIVE {PLACES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, listing_pos) AS k FROM f),
s(doc_id, page_index, k, kept) AS (SELECT doc_id, page_index, k, [k] FROM o WHERE k = 1
  UNION ALL SELECT s.doc_id, s.page_index, o.k, CASE WHEN EXISTS (SELECT 1 FROM o q WHERE q.doc_id = o.doc_id AND q.page_index = o.page_index AND list_contains(s.kept, q.k)
    AND (coalesce(q.digest = o.digest, false) OR (o.xref > 0 AND o.xref = q.xref)) AND abs(q.x0 - o.x0) <= 1 AND abs(q.y0 - o.y0) <= 1) THEN s.kept ELSE list_append(s.kept, o.k) END
  FROM s JOIN o ON o.doc_id = s.doc_id AND o.page_index = s.page_index AND o.k = s.k + 1),
l AS (SELECT doc_id, page_index, arg_max(kept, k) AS kept FROM s GROUP BY ALL)
SELECT o.doc_id, o.page_index, listing_pos, CAST(list_position(kept, o.k) AS INTEGER) AS image_index FROM o JOIN l USING (doc_id, page_index) WHERE list_contains(kept, o.k)"""

QUERIES = {
    "page_range": (page_range, RANGE),
    "page_selector": (page_selector, SELECTOR),
    "output_collisions": (output_collisions, COLLISIONS),
    "collision_report": (collision_report, REPORT),
    "skip_existing": (skip_existing, SKIP),
    "skip_existing_bucketed": (skip_existing_bucketed, SKIP),
    "page_names": (page_names, NAMES),
    "resolve_profile": (resolve_profile, PROFILE),
    "accepted_finish": (accepted_finish, FINISH),
    "render_scale": (render_scale, SCALE),
    "smart_resize": (smart_resize, SMART),
    "block_resize": (block_resize, BLOCKS),
    "resize_by_profile": (resize_by_profile, RESIZE),
    "source_metadata": (source_metadata, METADATA),
    "service_prompts": (service_prompts, PROMPTS),
    "chat_payload": (chat_payload, PAYLOAD),
    "validate_response": (validate_response, VALIDATE),
    "hub_model_filter": (hub_model_filter, HUB),
    "image_reading_order": (image_reading_order, READING),
    "image_dedup": (image_dedup, DEDUP),
}
