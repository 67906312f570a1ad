"""Summaries of areas and comparisons between them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralattice.operators.places import within

TOP = 25


def category_mix(df: DataFrame, top: int = TOP) -> DataFrame:
    """category, n, share and total; categories beyond the top are one row 'other', null ones 'uncategorized'."""
    counts = df.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # One row per category: the window sees the aggregate, not the places.
    every = Window.partitionBy()
    order = Window.orderBy(F.desc("n"), "category")
    ranked = counts.withColumns({"total": F.sum("n").over(every), "rank": F.row_number().over(order)})
    return (
        ranked.groupBy(F.when(F.col("rank") <= top, F.col("category")).otherwise("other").alias("category"), "total")
        .agg(F.sum("n").alias("n"))
        .withColumn("share", F.round(F.col("n") / F.col("total"), 3))
    )


def counts_by_predicate(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """All conditional counts in one scan."""
    return df.agg(*(F.count_if(p).alias(name) for name, p in predicates.items()))


def compare(df: DataFrame, centres: list[tuple[str, float, float]], metres: float) -> DataFrame:
    """area, category, n over all areas in one pass; a place in two areas counts in both."""
    tagged = None
    for name, lat, lon in centres:
        part = within(df, lat, lon, metres).withColumn("area", F.lit(name))
        tagged = part if tagged is None else tagged.unionAll(part)
    return tagged.groupBy("area", "category").agg(F.count(F.lit(1)).alias("n"))


def density(total: Column, metres: float) -> Column:
    """Per square kilometre of the circle."""
    return total / F.lit(math.pi * (metres / 1000) ** 2)


def top_categories(counts: DataFrame, per_area: int = TOP, k: int = 10) -> DataFrame:
    """Categories by their sum over the areas' own top lists."""
    own = Window.partitionBy("area").orderBy(F.desc("n"), "category")
    listed = counts.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= per_area)
    return listed.groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def differentiators(counts: DataFrame) -> DataFrame:
    """category, low, high, difference = (high - low) / high over the areas, absent ones as 0."""
    areas = counts.select("area").distinct()
    full = areas.crossJoin(counts.select("category").distinct()).join(counts, ["area", "category"], "left")  # two to five areas
    return (
        full.groupBy("category")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("low"), F.max(F.coalesce("n", F.lit(0))).alias("high"))
        .withColumn("difference", F.round((F.col("high") - F.col("low")) / F.col("high"), 2))
    )


def weighted_verdict(values: DataFrame) -> DataFrame:
    """area, score, winner from (area, priority, weight, fewer, n): shares of the best value times weights.

    More is better: n / max, and 1 if all are 0.  Fewer is better: min / n, and 1 where n is the least.
    """
    w = Window.partitionBy("priority")
    high, low = F.max("n").over(w), F.min("n").over(w)
    share = F.when(F.col("fewer"), F.when(F.col("n") == low, 1.0).otherwise(low / F.when(F.col("n") != 0, F.col("n")))).otherwise(
        F.when(high == 0, 1.0).otherwise(F.col("n") / F.when(high != 0, high))
    )
    scored = (
        values.withColumn("share", share)
        .groupBy("area")
        .agg(F.round(F.sum(F.col("share") * F.col("weight")), 3).alias("score"))
    )
    every = Window.partitionBy()  # one row per area
    ranked = scored.withColumn("top", F.max("score").over(every))
    at_top = F.col("score") == F.col("top")
    return ranked.withColumn("winner", at_top & (F.count_if(at_top).over(every) == 1)).drop("top")


def margin(scored: DataFrame) -> DataFrame:
    """How far the best area's score lies above the lowest, on every row; one row per area."""
    every = Window.partitionBy()
    return scored.withColumn("margin", F.round(F.max("score").over(every) - F.min("score").over(every), 3))


def building_summary(df: DataFrame) -> DataFrame:
    """One row over (subtype, height, num_floors, area_m2): counts, areas, what is known, means of what is known."""
    known = lambda c: F.round(F.count(c) / F.count(F.lit(1)), 3)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("area_m2"), 1).alias("total_area"),
        F.round(F.avg("area_m2"), 1).alias("mean_area"),
        known("height").alias("height_known"),
        known("num_floors").alias("floors_known"),
        F.round(F.avg("height"), 2).alias("mean_height"),
        F.round(F.avg("num_floors"), 2).alias("mean_floors"),
        F.count_if(F.col("subtype").isNull()).alias("uncategorized"),
    )


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k commonest values, ties by value."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
    )


def nearest_rank(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key and the value at a share of each key's sorted values, by the nearest rank.  One distributed sort, whatever a key's size."""
    from terralattice.operators.places import numbered
    from terralattice.sources.scratch import use_checkpoints

    use_checkpoints(df.sparkSession)
    ranked = numbered(df.filter(F.col(value).isNotNull()).select(key, value), [key, value]).checkpoint()
    per = ranked.groupBy(key).agg(F.min("number").alias("_first"), F.count(F.lit(1)).alias("_n"))
    wanted = per.select(key, (F.col("_first") + F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(1)) - 1).alias("number"))
    return ranked.join(wanted, [key, "number"]).select(key, value)
