"""Frequent itemsets and association rules over (basket, item) (FIM-*)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import stored


def singletons(pairs: DataFrame, support: float) -> DataFrame:
    """(itemset, freq) of single items in more than the share ``support`` of baskets."""
    n = pairs.agg(F.count_distinct("basket").alias("n"))
    counted = pairs.groupBy("item").agg(F.count_distinct("basket").alias("freq")).crossJoin(F.broadcast(n))
    return counted.filter(F.col("freq") > F.lit(support) * F.col("n")).select(F.array("item").alias("itemset"), "freq")


def frequent_itemsets(pairs: DataFrame, support: float = 0.01, most: int | None = None) -> DataFrame:
    """(itemset, freq), items ascending, of at most ``most`` items if given, in strictly more than ``support`` of the baskets.

    Level by level, until one is empty: a basket's frequent sets are extended by its frequent items that are larger than
    all of theirs, so that every set is made once a basket.
    """
    pairs = stored(pairs.select("basket", "item").distinct())
    n = pairs.select("basket").distinct().count()
    least = support * n
    level = stored(singletons(pairs, support))
    items = pairs.join(level.select(F.col("itemset")[0].alias("item")), "item", "left_semi")
    items = stored(items)
    held = items.select("basket", F.array("item").alias("itemset"))
    out = level
    for _ in itertools.count(1) if most is None else range(1, most):
        grown = held.join(items, "basket").filter(F.col("item") > F.element_at("itemset", -1)).select("basket", F.concat("itemset", F.array("item")).alias("itemset"))
        grown = stored(grown)
        level = stored(grown.groupBy("itemset").agg(F.count("*").alias("freq")).filter(F.col("freq") > least))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        held = grown.join(level.select("itemset"), "itemset", "left_semi")
    return out


def rules(pairs: DataFrame, itemsets: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(lhs, rhs, confidence), more than ``confidence``: of the baskets with lhs, the share that also has the item rhs, frequent or not."""
    pairs = pairs.select("basket", "item").distinct()
    sets = itemsets.select(F.col("itemset").alias("lhs"), F.col("freq").alias("n"), F.size("itemset").alias("k"))
    member = sets.select("lhs", "n", "k", F.explode("lhs").alias("item"))
    covered = pairs.join(member, "item").groupBy("basket", "lhs", "n", "k").agg(F.count("*").alias("has")).filter("has = k").select("basket", "lhs", "n")
    both = covered.join(pairs, "basket").filter(~F.array_contains("lhs", F.col("item"))).groupBy("lhs", "n", F.col("item").alias("rhs")).agg(F.count("*").alias("both"))
    return both.select("lhs", "rhs", (F.col("both") / F.col("n")).alias("confidence")).filter(F.col("confidence") > confidence)


def by_confidence(found: DataFrame) -> DataFrame:
    """Rules from the surest on; of equals by their items."""
    return found.orderBy(F.desc("confidence"), "lhs", "rhs")


def contains_all(items: Column, wanted: Column) -> Column:
    """Whether an array holds every element of another one."""
    return F.size(F.array_intersect(items, wanted)) == F.size(F.array_distinct(wanted))


def largest_item(pairs: DataFrame) -> DataFrame:
    """(item): the greatest of all baskets."""
    return pairs.agg(F.max("item").alias("item"))


def support_of(pairs: DataFrame, itemset: list) -> DataFrame:
    """(freq) of one itemset."""
    wanted = sorted(set(itemset))
    full = pairs.select("basket", "item").distinct().filter(F.col("item").isin(wanted)).groupBy("basket").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return full.agg(F.count("*").alias("freq"))
