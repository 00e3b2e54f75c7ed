"""Words and case as the operators here define them: ASCII white space and A-Z only, whatever the locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as characters and as a Java character class.
SPACES = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: str | Column) -> Column:
    """Number of words as a long; null text has none. Counts the places where a word starts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ascii_lower(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stripped(text: str | Column) -> Column:
    return F.btrim(text if isinstance(text, Column) else F.col(text), F.lit(SPACES))


def utf8_words(text: bytes) -> list[bytes]:
    """The same words from UTF-8: bytes.split() splits at exactly these six characters."""
    return text.split()
