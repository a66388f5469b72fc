"""Settings of a conversion, checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..sources.profiles import DEFAULT


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ImageExtraction:
    """Which placed images are kept."""

    enabled: bool = False
    bbox_tolerance: float = 1.0
    min_width: int = 32
    min_height: int = 32

    def __post_init__(self):
        _need(self.bbox_tolerance >= 0, "bbox_tolerance must not be negative")
        _need(self.min_width >= 1 and self.min_height >= 1, "min_width and min_height must be at least 1")


@dataclass(frozen=True)
class Render:
    """How a page becomes an image."""

    render_dpi: float | None = None
    target_longest_dim: int | None = 1288
    max_longest_dim: int | None = None
    min_shortest_dim: int | None = None
    resize_factor: int | None = None
    min_pixels: int | None = None
    max_pixels: int | None = None
    pixel_count_factor: int = 1

    def __post_init__(self):
        _need(self.render_dpi is not None or self.target_longest_dim is not None, "a resolution or a longest side must be set")
        for name, value in vars(self).items():
            _need(value is None or value > 0, f"{name} must be positive")
        _need(self.resize_factor is not None or (self.min_pixels is None and self.max_pixels is None), "pixel bounds need a resize factor")
        _need(self.min_pixels is None or self.max_pixels is None or self.min_pixels <= self.max_pixels, "min_pixels is above max_pixels")


@dataclass(frozen=True)
class Conversion:
    """A whole job. The key is read from the environment where none is given, and is never written to a table."""

    service: str = DEFAULT
    timeout: float = 120.0
    concurrency: int = 4
    max_page_attempts: int = 8
    allow_page_failures: bool = True
    include_page_numbers: bool = False
    namespace: str = "pagemill"
    images: ImageExtraction = field(default_factory=ImageExtraction)

    def __post_init__(self):
        _need(self.timeout > 0, "timeout must be positive")
        _need(self.concurrency >= 1, "concurrency must be at least 1")
        _need(self.max_page_attempts >= 1, "max_page_attempts must be at least 1")


def api_key(given: str | None = None) -> str | None:
    return given or os.environ.get("OPENAI_API_KEY") or os.environ.get("API_KEY") or None
