"""Words of texts as DataFrame expressions: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def joined_words(text: Column) -> Column:
    """The words of a text with one space between them; '' for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))


def split_words(joined: Column) -> Column:
    """The array of what `joined_words` gave."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def strings(values: Sequence[str]) -> Column:
    """An array of words as one literal."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")
