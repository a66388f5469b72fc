"""Model and render profiles, and aliases of models, as small tables. Their contents are fixed values.

The tables' sizes are fixed by this file, so joins may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prompts import OF_MODEL

IMAGE_TOKENS = "<|img|><|imgpad|><|endofimg|>"
STOP, LENGTH = ["", "stop", "end_turn"], ["", "stop", "end_turn", "length"]  # "" stands for no reason given

#: name, render_dpi, target_longest_dim, max_longest_dim, min_shortest_dim, resize_factor, min_pixels, max_pixels, pixel_count_factor, strategy, resample, format
RENDER = [
    ("default", None, 1288, None, None, None, None, None, 1, "smart", "bicubic", "PNG"),
    ("GLM", 200.0, None, 3500, None, 28, 12_544, 1_003_520, 2, "smart", "bicubic", "JPEG"),
    ("DOTS", 200.0, None, 4500, None, None, None, None, 1, "smart", "bicubic", "PNG"),
    ("DEEPSEEK", 144.0, None, None, None, None, None, None, 1, "smart", "bicubic", "PNG"),
    ("UNLIMITED", None, 1288, None, None, None, None, None, 1, "smart", "bicubic", "PNG"),
    ("FIRERED", 200.0, None, 3500, None, None, None, None, 1, "smart", "bicubic", "PNG"),
    ("INFINITY", 300.0, None, None, None, 32, 2_048, 16_777_216, 1, "smart", "bicubic", "PNG"),
    ("CHANDRA", 192.0, None, None, 1024, 28, 50_176, 6_291_456, 1, "blocks", "lanczos", "PNG"),
]
RENDER_SCHEMA = "profile string, render_dpi double, target_longest_dim long, max_longest_dim long, min_shortest_dim long, resize_factor long, min_pixels long, max_pixels long, pixel_count_factor long, strategy string, resample string, image_format string"

#: name, model, parser, max_tokens, token_param, temperature, top_p, top_k, repetition_penalty, extra_body, image_first, text_prefix, render profile, accepted finish reasons
MODELS = [
    ("zai-org/GLM-OCR", "zai-org/GLM-OCR", "markdown", 16384, "max_tokens", 0.01, 0.00001, 1, 1.1, None, True, "", "GLM", STOP),
    ("rednote-hilab/dots.mocr", "rednote-hilab/dots.mocr", "dots_layout_json", 32768, "max_completion_tokens", 0.1, 0.9, None, None, None, True, "", "DOTS", STOP),
    ("rednote-hilab/dots.mocr-svg", "rednote-hilab/dots.mocr-svg", "svg", 32768, "max_completion_tokens", 0.9, 1.0, None, None, None, True, "", "DOTS", LENGTH),
    ("rednote-hilab/dots.ocr-1.5", "rednote-hilab/dots.ocr-1.5", "dots_layout_json", 32768, "max_completion_tokens", 0.1, 0.9, None, None, None, True, IMAGE_TOKENS, "DOTS", STOP),
    ("rednote-hilab/dots.ocr-1.5-svg", "rednote-hilab/dots.ocr-1.5-svg", "svg", 32768, "max_completion_tokens", 0.9, 1.0, None, None, None, True, IMAGE_TOKENS, "DOTS", LENGTH),
    ("rednote-hilab/dots.ocr", "rednote-hilab/dots.ocr", "dots_layout_json", 32768, "max_completion_tokens", 0.1, 0.9, None, None, None, True, IMAGE_TOKENS, "DOTS", STOP),
    ("deepseek-ai/DeepSeek-OCR", "deepseek-ai/DeepSeek-OCR", "deepseek_markdown", 8192, "max_tokens", 0.0, None, None, None, '{"include_stop_str_in_output":true,"skip_special_tokens":false}', True, "<|grounding|>", "DEEPSEEK", STOP),
    ("baidu/Unlimited-OCR", "Unlimited-OCR", "unlimited_ocr", 4096, "max_tokens", 0.0, None, None, None, '{"skip_special_tokens":false,"dry_multiplier":1.2,"dry_base":1.75,"dry_allowed_length":1,"dry_penalty_last_n":128,"dry_sequence_breakers":[""]}', False, "", "UNLIMITED", LENGTH),
    ("FireRedTeam/FireRed-OCR-2B", "FireRedTeam/FireRed-OCR-2B", "markdown", 8192, "max_tokens", 0.0, None, None, None, None, True, "", "FIRERED", STOP),
    ("infly/Infinity-Parser2-Pro", "infly/Infinity-Parser2-Pro", "infinity_layout_json", 32768, "max_tokens", 0.0, 1.0, None, None, '{"chat_template_kwargs":{"enable_thinking":false}}', True, "", "INFINITY", LENGTH),
    ("infly/Infinity-Parser2-Flash", "infly/Infinity-Parser2-Flash", "infinity_layout_json", 32768, "max_tokens", 0.0, 1.0, None, None, '{"chat_template_kwargs":{"enable_thinking":false}}', True, "", "INFINITY", LENGTH),
    ("datalab-to/chandra-ocr-2", "datalab-to/chandra-ocr-2", "chandra_html", 12384, "max_tokens", 0.0, 0.1, None, None, None, True, "", "CHANDRA", STOP),
]
MODEL_SCHEMA = "name string, model string, parser string, max_tokens long, token_param string, temperature double, top_p double, top_k long, repetition_penalty double, extra_body string, image_first boolean, text_prefix string, profile string, accepted array<string>"

ALIASES = [
    ("chandra", "datalab-to/chandra-ocr-2"),
    ("glm-ocr", "zai-org/GLM-OCR"),
    ("glmocr", "zai-org/GLM-OCR"),
    ("deepseek-ocr", "deepseek-ai/DeepSeek-OCR"),
    ("unlimited-ocr", "baidu/Unlimited-OCR"),
    ("dots.mocr", "rednote-hilab/dots.mocr"),
    ("dots.mocr-svg", "rednote-hilab/dots.mocr-svg"),
    ("dots.ocr", "rednote-hilab/dots.ocr-1.5"),
    ("dots.ocr-1.5", "rednote-hilab/dots.ocr-1.5"),
    ("dots.ocr-1.5-svg", "rednote-hilab/dots.ocr-1.5-svg"),
    ("firered-ocr", "FireRedTeam/FireRed-OCR-2B"),
    ("firered-ocr-2b", "FireRedTeam/FireRed-OCR-2B"),
    ("infinity-parser2", "infly/Infinity-Parser2-Pro"),
    ("infinity-parser2-pro", "infly/Infinity-Parser2-Pro"),
    ("infinity-parser2-flash", "infly/Infinity-Parser2-Flash"),
]
#: The service that is used where none is named.
DEFAULT = "zai-org/GLM-OCR"


def render_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RENDER, RENDER_SCHEMA)


def model_profiles(spark: SparkSession) -> DataFrame:
    """All profiles, with the prompt of each."""
    return spark.createDataFrame([(*m, OF_MODEL[m[0]]) for m in MODELS], f"{MODEL_SCHEMA}, prompt string")


def listing(spark: SparkSession) -> DataFrame:
    """name and two lines about each profile, for people who look for a service."""
    said = F.format_string("%s (model %s)\n  parser %s, render profile %s, at most %s tokens", "name", "model", "parser", "profile", F.col("max_tokens").cast("string"))
    return model_profiles(spark).select("name", said.alias("lines"))


def model_keys(spark: SparkSession) -> DataFrame:
    """key (lower case) and name: all names and aliases; an alias hides a name that is spelt like it."""
    return spark.createDataFrame(list(({m[0].lower(): m[0] for m in MODELS} | dict(ALIASES)).items()), "key string, canonical string")


def resolve(services: DataFrame, column: str = "service") -> DataFrame:
    """Adds canonical: the profile's name for a name or alias in any case; an unknown one stays as it is, stripped."""
    from ..functions.text import strip

    bare = F.regexp_replace(strip(F.col(column)), r"/+\z", "")
    keys = F.broadcast(model_keys(services.sparkSession))
    return services.withColumn("__bare", bare).join(keys, F.lower("__bare") == F.col("key"), "left").withColumn("canonical", F.coalesce("canonical", "__bare")).drop("key", "__bare")


def with_profile(services: DataFrame, column: str = "service") -> DataFrame:
    """Adds the profile's columns, and error: for an unknown service, a message that lists the known ones."""
    spark = services.sparkSession
    known = ", ".join(m[0] for m in MODELS)
    joined = resolve(services, column).join(F.broadcast(model_profiles(spark)), F.col("canonical") == F.col("name"), "left")
    return joined.withColumn("error", F.when(F.col("name").isNull(), F.concat(F.lit("unsupported service: "), F.col(column), F.lit(". Supported: " + known))))


def accepts(reason: Column, accepted: Column) -> Column:
    """Whether a finish reason ends a response well; no reason is one that can be accepted."""
    return F.array_contains(accepted, F.coalesce(reason, F.lit("")))
