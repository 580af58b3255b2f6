"""Predicates and splits of text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines with their ends kept; `\\n`, `\\r\\n` and bare `\\r` end a line."""
    return F.regexp_extract_all(text, F.lit(r"([^\r\n]*(\r\n|\n|\r)|[^\r\n]+$)"), F.lit(0))


def looks_binary(body: Column) -> Column:
    """If bytes have a NUL or aren't UTF-8."""
    return (F.locate("\x00", F.decode(body, "ISO-8859-1")) > 0) | ~F.is_valid_utf8(body.cast("string"))


def has_conflict_markers(text: Column) -> Column:
    """If the three markers of a conflict stand at line starts in order."""
    return F.regexp_replace(text, "\r\n?", "\n").rlike(r"(?ms)^<<<<<<<.*^=======$.*^>>>>>>>")


def subject(message: Column) -> Column:
    return F.split(message, "\n")[0]
