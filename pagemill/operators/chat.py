"""Requests to chat endpoints and what comes back, as JSON columns; the transport is pluggable (see inference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_text(content: Column) -> Column:
    """The text of a message content (a variant): a string, or the joined texts of its parts; null for anything else.

    A part's text is the key ``text`` if that is a string, or ``text.value``; other parts don't count.
    """
    kind = F.schema_of_variant(content)
    of = lambda p: F.when(F.schema_of_variant(F.variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")).when(
        F.schema_of_variant(F.variant_get(p, "$.text.value", "variant")) == "STRING", F.try_variant_get(p, "$.text.value", "string")
    )
    parts = F.array_join(F.filter(F.transform(content.try_cast("array<variant>"), of), lambda t: t.isNotNull()), "")
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), parts)


def validate(responses: DataFrame, accepted: Column) -> DataFrame:
    """From body (JSON): text, prompt_tokens, completion_tokens, finish_reason, error_kind and retryable.

    The first check that fails names the error; only a finish reason that isn't accepted makes trying again useless.
    """
    body = F.try_parse_json("body")
    get = F.try_variant_get
    rows = responses.withColumn("__b", body).withColumn("__choice", F.variant_get("__b", "$.choices[0]", "variant")).withColumn("__message", F.variant_get("__choice", "$.message", "variant"))
    rows = rows.withColumn("text", message_text(F.variant_get("__message", "$.content", "variant"))).withColumn("finish_reason", get("__choice", "$.finish_reason", "string"))
    is_object = lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT"))
    tokens = lambda key: F.coalesce(get("__b", f"$.usage.{key}", "long"), F.lit(0)).cast("long")
    from ..functions.text import strip

    error = (
        F.when(F.col("__choice").isNull(), "choices missing").when(~is_object(F.col("__choice")), "choice invalid")
        .when(F.col("__message").isNull() | ~is_object(F.col("__message")), "message missing").when(F.col("text").isNull(), "content type")
        .when(strip(F.col("text")) == "", "content empty").when(~F.array_contains(accepted, F.coalesce("finish_reason", F.lit(""))), "finish reason")
    )
    out = rows.withColumn("prompt_tokens", tokens("prompt_tokens")).withColumn("completion_tokens", tokens("completion_tokens")).withColumn("error_kind", error)
    return out.withColumn("retryable", F.when(F.col("error_kind").isNotNull(), F.col("error_kind") != "finish reason")).drop("__b", "__choice", "__message")


def payload(prompt: Column, data_uri: Column, p: dict[str, Column]) -> Column:
    """The JSON of a request: model, one message with the image and the text, the token limit under its own name, and what else is set.

    Keys of ``extra_body`` override others: the objects are joined and a later key wins when the JSON is read.
    """
    said = F.struct(F.lit("text").alias("type"), F.concat(F.coalesce(p["text_prefix"], F.lit("")), prompt).alias("text"))
    image = F.struct(F.lit("image_url").alias("type"), F.struct(data_uri.alias("url")).alias("image_url"))
    a, b = F.to_json(said), F.to_json(image)
    content = F.when(p["image_first"], F.concat(b, F.lit(","), a)).otherwise(F.concat(a, F.lit(","), b))
    message = F.concat(F.lit('"messages":[{"role":"user","content":['), content, F.lit("]}]"))
    own = F.to_json(
        F.struct(
            p["model"].alias("model"), F.when(p["token_param"] == "max_tokens", p["max_tokens"]).alias("max_tokens"), F.when(p["token_param"] == "max_completion_tokens", p["max_tokens"]).alias("max_completion_tokens"),
            p["temperature"].alias("temperature"), p["top_p"].alias("top_p"), p["top_k"].alias("top_k"), p["repetition_penalty"].alias("repetition_penalty"),
        )
    )
    inner = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
    extra = F.when(p["extra_body"].isNotNull() & (F.length(p["extra_body"]) > 2), inner(p["extra_body"]))
    return F.concat(F.lit("{"), F.concat_ws(",", inner(own), message, extra), F.lit("}"))
