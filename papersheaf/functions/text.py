"""Column expressions over page and document text.

The classes are spelled out so that they cover Unicode letters, digits and spaces alike in
Spark and in other engines; Java's bare ``\\w`` and ``\\s`` are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersheaf.functions.binding import bind

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
KEPT = r"\p{L}\p{N}_.,!?;:\-()"
LETTER_OR_DIGIT = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++$", "")


def clean_text(text: Column) -> Column:
    """Collapse white space, drop all but word characters and basic punctuation.

    Null, empty and texts of at most three characters become ``''``; that length counts dropped
    characters inside the text as single spaces, before spaces are merged. White space and dropped
    characters both end as one space, so one pass over the text gives the result, and the longer form
    is made only for results too short to settle the length test. Single spaces are not touched.
    """
    body = F.coalesce(text, F.lit(""))
    merged = F.trim(F.regexp_replace(body, f"[^{KEPT} ][^{KEPT}]*+| [^{KEPT}]++", " "))
    spaced = F.regexp_replace(F.regexp_replace(body, f"{SPACE}+", " "), f"[^{KEPT} ]", " ")
    return bind(
        merged,
        lambda m: F.when(F.length(m) > 3, m).when(F.length(F.trim(spaced)) > 3, m).otherwise(""),
    )


def count_chars(cleaned: Column) -> Column:
    return F.length(cleaned)


def count_words(cleaned: Column) -> Column:
    """Words of a cleaned text: one more than its single spaces, none for ``''``."""
    spaces = F.length(cleaned) - F.length(F.translate(cleaned, " ", ""))
    return F.when(cleaned == "", 0).otherwise(spaces + 1)


def words(cleaned: Column) -> Column:
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def first_n_words(cleaned: Column, n: int = 512) -> Column:
    """Everything before the n-th space, which needs no array of words."""
    return F.substring_index(cleaned, " ", n)


def sentence_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ".!?", ""))


def lowercase_words(text: Column, min_length: int = 4) -> Column:
    """All whole words made of at least ``min_length`` letters a-z, after lower-casing."""
    pattern = rf"((?<!{LETTER_OR_DIGIT})[a-z]{{{min_length},}}+(?!{LETTER_OR_DIGIT}))"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
