"""Word and line expressions that several operators share; words are `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters between words.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """array<string> of the words of a text; null gives an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(plain, " "), "")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(words(text)).cast("long")
