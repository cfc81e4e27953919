"""Column helpers for operators that stay in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import let

__all__ = ["each_run", "folded_words", "let", "plain_words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, unchanged; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def folded_words(text) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; none of a null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def each_run(words: Column, k: int, body) -> Column:
    """body(i) for every 1-based start i of k consecutive elements; an empty array of long if there are fewer."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), body))
