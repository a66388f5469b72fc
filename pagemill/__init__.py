"""A document-conversion engine expressed as PySpark DataFrame pipelines."""

from .operators.batch import failure_report, outcomes, summary
from .operators.pages import PARSERS, parse, segment_blocks
from .plans.config import Conversion, Render
from .plans.convert import convert, page_results
from .sources.profiles import accepts, listing, model_profiles, render_profiles, resolve, with_profile
from .sources.responses import infer, read_captured

__all__ = [
    "PARSERS", "Conversion", "Render", "accepts", "convert", "failure_report", "infer", "listing", "model_profiles", "outcomes", "page_results", "parse",
    "read_captured", "render_profiles", "resolve", "segment_blocks", "summary", "with_profile",
]
