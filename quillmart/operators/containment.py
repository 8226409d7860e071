"""Joins of texts with the words that are inside them, as equi-joins on substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substrings(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of a text that have one of ``sizes`` characters."""
    none = F.array().cast("array<string>")

    def of_size(n: Column) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, sizes)), of_size))) if sizes else none


def prefixes(text: Column, sizes: list[int]) -> Column:
    """The beginnings of a text that have one of ``sizes`` characters."""
    pieces = F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(F.length(text) >= n, F.substring(text, F.lit(1), n)))
    return F.array_compact(pieces) if sizes else F.array().cast("array<string>")


def join_inside(texts: DataFrame, text_col: str, words: DataFrame, word_col: str, start: bool = False) -> DataFrame:
    """``texts`` with every row of ``words`` whose ``word_col`` is inside ``text_col``, or begins it where ``start`` is set.

    The driver takes the distinct lengths of words, not the words; a text is cut into pieces of those lengths and pieces
    meet words by an equi-join, so nothing is compared that is not equal. Null and empty words and texts meet nothing.
    Apart from the two key columns, column names of the frames must differ.
    """
    sizes = [r["n"] for r in words.select(F.length(word_col).alias("n")).distinct().collect() if r["n"]]
    pieces = prefixes(F.col(text_col), sizes) if start else substrings(F.col(text_col), sizes)
    cut = texts.withColumn("__piece", F.explode(pieces))
    return cut.join(words, F.col("__piece") == words[word_col]).drop("__piece")
