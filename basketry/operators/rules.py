"""Association rules with consequents of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.sets import proper_splits


def rules(itemsets: DataFrame, minconf: float) -> DataFrame:
    """antecedent, consequent, support, confidence of every split of a frequent itemset that reaches ``minconf``.

    Confidence only falls as the consequent grows, so trying all splits finds what pruning by
    failed consequents would.
    """
    if minconf <= 0:
        raise ValueError("minconf must be positive")
    splits = itemsets.filter(F.size("itemset") >= 2).select("support", F.explode(proper_splits(F.col("itemset"))).alias("r"))
    splits = splits.select("support", "r.antecedent", "r.consequent")
    given = itemsets.select(F.col("itemset").alias("antecedent"), F.col("support").alias("of_antecedent"))
    found = splits.join(given, "antecedent").withColumn("confidence", F.col("support") / F.col("of_antecedent"))
    return found.filter(F.col("confidence") >= minconf).select("antecedent", "consequent", "support", "confidence")
