"""Parsing of basket strings and documents, and the rolling hash of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basket_items(data: Column, separator: str = ",") -> Column:
    """Items of a basket string: trimmed of spaces, empty ones dropped."""
    return F.filter(F.transform(F.split(data, separator), lambda x: F.trim(x)), lambda x: x != "")


#: What stands in for a segmenter and its word classes: four letters or more, of any script.
WORD = r"\p{L}{4,}"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def pos_kept(tag: Column, word_id: Column) -> Column:
    """Word classes that documents are described by: persons, places, verbs, adjectives, of known words."""
    return tag.rlike("^(n[rs]|v|a)") & (word_id > 0)


def polynomial_hash(text: Column, slots: int) -> Column:
    """h = 37 h + c over the characters' codes, 32 bits wide, modulo ``slots``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 37 + c).bitwiseAND(F.lit(4294967295))) % slots
