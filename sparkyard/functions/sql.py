"""Fragments of the SQL that results are held against; they mirror :mod:`sparkyard.functions.text`."""

from __future__ import annotations

WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def strip_or_null(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def folded(c: str) -> str:
    return f"lower({strip_or_null(c)})"


def split_name(c: str) -> str:
    return f"CASE {folded(c)} WHEN 'valid' THEN 'val' ELSE {folded(c)} END"


def path_text(c: str) -> str:
    return f"replace({strip_or_null(c)}, '\\', '/')"


def file_name(c: str) -> str:
    return f"nullif(regexp_extract({path_text(c)}, '[^/]*$'), '')"
