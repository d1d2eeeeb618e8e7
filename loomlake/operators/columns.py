"""Names for values inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    r"""A text without the characters of ``\s`` at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))
