"""Words: maximal runs of letters, digits and underscores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{IsAlphabetic}\p{N}_]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, NON_WORD), lambda w: w != F.lit(""))


def has_word(text: Column, word: str) -> Column:
    """Some word equals ``word``.  The cheap ``contains`` keeps most rows from being split."""
    if word == "":
        return text.isNotNull()
    return text.contains(word) & F.array_contains(F.split(text, NON_WORD), word)
