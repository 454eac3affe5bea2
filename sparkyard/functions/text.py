"""Normalisation of ids, paths, digests and split names as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space (Unicode White_Space, and the four separators U+001C to U+001F).
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without white space around it; null stays null."""
    return F.btrim(c, F.lit(WHITE))


def strip_or_null(c: Column) -> Column:
    """As :func:`strip`; an empty or blank text becomes null."""
    return F.nullif(strip(c), F.lit(""))


def folded(c: Column) -> Column:
    """An id or digest compared without case and without white space around it; blank becomes null."""
    return F.lower(strip_or_null(c))


def split_name(c: Column) -> Column:
    """Lower-case split name; ``valid`` is ``val``; blank becomes null."""
    s = folded(c)
    return F.when(s == "valid", F.lit("val")).otherwise(s)


def path_text(c: Column) -> Column:
    """A path with ``/`` only and no white space around it; blank becomes null."""
    return F.translate(strip_or_null(c), "\\", "/")


def file_name(c: Column) -> Column:
    """The part of the path after its last ``/`` or ``\\``; null when that part is empty."""
    return F.nullif(F.substring_index(path_text(c), "/", -1), F.lit(""))
