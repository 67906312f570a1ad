"""What changed between two releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change, name, category, confidence of a full outer join by id; changed if name or category differ, null equal to null."""
    a = before.filter("id IS NOT NULL").select("id", F.struct("name", "category", "confidence").alias("a"))
    b = after.filter("id IS NOT NULL").select("id", F.struct("name", "category", "confidence").alias("b"))
    differs = ~F.col("a.name").eqNullSafe(F.col("b.name")) | ~F.col("a.category").eqNullSafe(F.col("b.category"))
    change = (
        F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "disappeared").when(differs, "changed").otherwise("unchanged")
    )
    now = F.coalesce("b", "a")
    return a.join(b, "id", "full_outer").select(
        "id", change.alias("change"), now["name"].alias("name"), now["category"].alias("category"), now["confidence"].alias("confidence")
    )


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def breakdown(changes: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest categories of each kind of change."""
    per = changes.groupBy("change", F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("change").orderBy(F.desc("n"), "category")
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def digest(changes: DataFrame, k: int = 8) -> DataFrame:
    """Up to k rows of each change but 'unchanged', surest first, null confidence last, then name and id."""
    order = Window.partitionBy("change").orderBy(F.desc(F.coalesce("confidence", F.lit(-1.0))), F.asc_nulls_last("name"), "id")
    return changes.filter("change <> 'unchanged'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sample_by_id(df: DataFrame, limit: int = 3000) -> DataFrame:
    """The first ids, so that two sides are sampled alike; only where a bounded comparison is asked for."""
    return df.orderBy("id").limit(limit)
