"""Text normalisation as column expressions: ASCII rules only, other bytes stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize(text: Column) -> Column:
    """White space to single spaces, ASCII punctuation removed, A-Z lower-cased, trimmed."""
    spaced = F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")
    plain = F.regexp_replace(spaced, "[!-/:-@\\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.translate(plain, UPPER, LOWER), " +", " "))


def terms(text: Column) -> Column:
    """The words of a normalised text, repeats included; none for a blank one."""
    n = normalize(text)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def has_term(text: Column) -> Column:
    """Whether a text has a character that normalisation keeps."""
    return text.rlike("[^ \\t\\n\\x0B\\f\\r!-/:-@\\[-`{-~]")


_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PUNCTUATION = bytes(c for c in range(128) if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def words_of(text: bytes) -> list[bytes]:
    """The same as ``terms``, of UTF-8 bytes."""
    return text.translate(_LOWERED, _PUNCTUATION).split()
