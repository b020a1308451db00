"""Cleaning and word windows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import let

# The 29 characters that count as whitespace. Java's ``\s`` knows only six.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
MAX_WORDS = 500


def clean_text(text: Column) -> Column:
    """Each run of whitespace becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def words(cleaned: Column) -> Column:
    """Words of text that went through ``clean_text``; blank text has none."""
    return F.filter(F.split(cleaned, " "), lambda word: word != "")


def raw_words(text: Column) -> Column:
    """Words of any text, without cleaning it first."""
    return F.filter(F.split(text, WHITESPACE), lambda word: word != "")


def word_windows(word_list: Column, max_words: int = MAX_WORDS) -> Column:
    """Consecutive windows of ``max_words`` words joined by a space; the last may be short."""

    def cut(ws):
        count = F.ceil(F.size(ws) / F.lit(float(max_words))).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.array_join(F.slice(ws, i * max_words + 1, F.lit(max_words)), " "),
        )

    return let(word_list, cut)


def chunk_text(text: Column, max_words: int = MAX_WORDS) -> Column:
    """Raw text to its array of chunks."""
    return word_windows(words(clean_text(text)), max_words)
