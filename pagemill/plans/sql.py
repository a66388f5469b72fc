"""Pieces of DuckDB SQL that several reference queries share."""

from __future__ import annotations

CLASS = r"[ \t\r\n\f\x0b]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{CLASS}+|{CLASS}+\z', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{CLASS}+\z', '')"
