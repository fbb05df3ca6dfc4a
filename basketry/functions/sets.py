"""Itemsets as ascending arrays without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(items: Column) -> Column:
    """Ascending, each item once."""
    return F.array_sort(F.array_distinct(items))


def union_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def subtract_set(a: Column, b: Column) -> Column:
    """The larger operand without the smaller one's items."""
    return F.array_sort(F.when(F.size(a) >= F.size(b), F.array_except(a, b)).otherwise(F.array_except(b, a)))


def union_equal_prefix(a: Column, b: Column) -> Column:
    """Union of two sets of one size that differ in the last item only, else null."""
    n = F.size(a)
    fits = (n == F.size(b)) & (n > 0) & (F.slice(a, 1, n - 1) == F.slice(b, 1, n - 1)) & (F.element_at(a, -1) != F.element_at(b, -1))
    return F.when(fits, union_set(a, b))


def is_subset(whole: Column, part: Column) -> Column:
    """Whether all of ``part`` is in ``whole``; false if either is empty."""
    return (F.size(whole) > 0) & (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def search(items: Column, key: Column) -> Column:
    """Of an ascending array: struct of position (from 0; where the key would stand) and found."""
    before = F.size(F.filter(items, lambda x: x < key))
    return F.struct(before.alias("position"), F.array_contains(items, key).alias("found"))


def subsets_of_size_less_one(items: Column) -> Column:
    """The k subsets that leave out one item each."""
    return F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.filter(items, lambda x, k: k + 1 != i))


def proper_splits(items: Column) -> Column:
    """All ways to split a set into two parts that are not empty: array of antecedent, consequent."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 2).cast("int"))

    def part(mask: Column, bit: int) -> Column:
        return F.filter(items, lambda x, k: F.getbit(mask.cast("long"), k) == bit)

    return F.transform(masks, lambda m: F.struct(part(m, 1).alias("antecedent"), part(m, 0).alias("consequent")))


def text_of(items: Column) -> Column:
    """An itemset as text: items with commas between."""
    return F.array_join(items, ",")
