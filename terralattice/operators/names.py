"""Search by name: alternate names, tiers, fuzzy matches, ranking, categories, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralattice.functions import text as X


def alternate_names(df: DataFrame, names: str = "common", primary: str = "name") -> DataFrame:
    """id, folded, alt: distinct folded spellings out of a map of names, without those that fold like the primary name."""
    spelled = df.select("id", X.fold(F.col(primary)).alias("_own"), F.explode(F.array_distinct(F.map_values(names))).alias("alt"))
    return (
        spelled.withColumn("folded", X.fold(F.col("alt")))
        .filter(~F.col("folded").eqNullSafe(F.col("_own")))
        .groupBy("id", "folded")
        .agg(F.min("alt").alias("alt"))
    )


def write_name_table(df: DataFrame, path: str) -> None:
    """The name table: id, name, its folded form, subtype, region, population, sorted by the folded name so that footers prune."""
    kept = [c for c in ("id", "name", "subtype", "country", "region", "population", "lat", "lon") if c in df.columns]
    df.select(*kept, X.fold(F.col("name")).alias("folded")).repartitionByRange("folded").sortWithinPartitions("folded").write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(path)


def write_alternates(df: DataFrame, path: str, names: str = "common", primary: str = "name") -> None:
    alternate_names(df, names, primary).write.mode("overwrite").option("compression", "zstd").parquet(path)


def name_index(df: DataFrame, alternates: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The divisions with the largest known populations, and the alternate names of these alone."""
    top = df.filter(F.col("name").isNotNull() & (F.col("population") > 0)).orderBy(F.desc("population"), "id").limit(most)
    return top, alternates.join(top.select("id"), "id", "left_semi")


def by_alternate(df: DataFrame, alternates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query and id whose alternate spelling folds like the query: best population first, then spelling."""
    hits = queries.select("query", X.fold(F.col("query")).alias("folded")).join(alternates, "folded").join(df, "id")
    order = Window.partitionBy("query", "id").orderBy(F.col("population").desc_nulls_last(), "alt")
    return hits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "folded")


def tiered(df: DataFrame, queries: DataFrame, per_query: int = 50) -> DataFrame:
    """query, id, tier: exact 3, prefix 2, substring 1 on folded names.

    Queries are a stated set; names meet them through the grams they share, so there is no cross join: a match of any tier holds the
    query's first three characters, or the whole of a shorter query.
    """
    folded = df.withColumn("_name", X.fold(F.col("name")))
    asked = queries.withColumn("_q", X.fold(F.col("query")))
    starts = lambda c: F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    grams = lambda c: F.array_distinct(
        F.flatten(F.transform(starts(c), lambda i: F.array(*(F.substr(c, i, F.lit(n)) for n in (1, 2, 3)))))
    )
    left = folded.withColumn("_g", F.explode(grams(F.col("_name"))))
    right = asked.withColumn("_g", F.substr(F.col("_q"), F.lit(1), F.lit(3)))
    tier = F.when(F.col("_name") == F.col("_q"), 3).when(F.col("_name").startswith(F.col("_q")), 2).when(F.col("_name").contains(F.col("_q")), 1)
    found = left.join(right, "_g").withColumn("tier", tier).filter("tier IS NOT NULL").drop("_g", "_name", "_q")
    order = Window.partitionBy("query").orderBy(F.desc("tier"), F.col("population").desc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_query)


def fuzzy(names: DataFrame, queries: DataFrame, threshold: float = X.FUZZY_THRESHOLD) -> DataFrame:
    """query, name, similarity of distinct names; the stated set of queries is compared with every name."""
    pairs = names.select("name").distinct().crossJoin(F.broadcast(queries.select("query").distinct()))
    return pairs.select("query", "name").withColumn("similarity", X.jaro_winkler(X.fold(F.col("name")), X.fold(F.col("query")))).filter(
        F.col("similarity") >= threshold
    )


def gate_tiers(df: DataFrame, by: str = "query", tier: str = "stage") -> DataFrame:
    """Of several stages only the first that found anything, per query."""
    return df.withColumn("_first", F.min(tier).over(Window.partitionBy(by))).filter(F.col(tier) == F.col("_first")).drop("_first")


def rank_score(tier: Column, subtype_weight: Column, population: Column, variant: Column, is_fuzzy: Column) -> Column:
    base = F.when(is_fuzzy, 0.3).when(tier == 3, 1.0).when(tier == 2, 0.7).otherwise(0.4)
    people = F.least(F.lit(0.05), F.log10(F.coalesce(population, F.lit(0)) + F.lit(1.0)) / 140)
    return base + subtype_weight * 0.01 + people - F.when(variant, 0.01).otherwise(0.0)


def token_weights(taxonomy: DataFrame) -> DataFrame:
    """token, df, weight = ln(N / df) / ln(N), df over slugs, the larger of singular and plural."""
    n = taxonomy.agg(F.count(F.lit(1)).alias("n_all"))
    tokens = taxonomy.select("slug", F.explode(F.array_distinct(F.split("words", r"\s+"))).alias("token"))
    df = tokens.groupBy("token").agg(F.countDistinct("slug").alias("df"))
    stems = df.withColumn("stem", X.stem(F.col("token")))
    widest = stems.withColumn("df", F.max("df").over(Window.partitionBy("stem")))
    # One row of totals.
    return widest.crossJoin(F.broadcast(n)).select("token", "df", (F.log(F.col("n_all") / F.col("df")) / F.log("n_all")).alias("weight"))


def search_categories(taxonomy: DataFrame, query: str) -> DataFrame:
    """slug, confidence: exact 1, prefix .9, substring .75, on the path .6; else weighted token coverage from .2 to .55."""
    q = query.lower().strip().replace(" ", "_")
    direct = (
        F.when(F.col("slug") == q, 1.0)
        .when(F.col("slug").startswith(q), 0.9)
        .when(F.col("slug").contains(q), 0.75)
        .when(F.array_contains("path", q), 0.6)
    )
    words = sorted({w for w in query.lower().split() if w})
    weights = token_weights(taxonomy).filter(F.col("token").isin(words))
    total = weights.agg(F.sum("weight").alias("total"))
    tokens = taxonomy.select("slug", F.explode(F.array_distinct(F.split("words", r"\s+"))).alias("token"))
    covered = (
        tokens.join(weights, "token")
        .groupBy("slug")
        .agg(F.sum("weight").alias("got"), F.max("weight").alias("best"))
        .filter("best >= 0.5")
        .crossJoin(F.broadcast(total))
        .select("slug", (F.lit(0.2) + 0.35 * F.col("got") / F.col("total")).alias("coverage"))
    )
    return (
        taxonomy.join(covered, "slug", "left")
        .select("slug", F.round(F.coalesce(direct, F.col("coverage")), 3).alias("confidence"))
        .filter("confidence IS NOT NULL")
        .orderBy(F.desc("confidence"), F.length("slug"), "slug")
    )


def dedup_addresses(df: DataFrame) -> DataFrame:
    """One row per number, street and postcode of rows with a distance: unit only if there is one, place of the nearest."""
    return df.groupBy("number", "street", "postcode").agg(
        F.when(F.countDistinct("unit") == 1, F.min("unit")).alias("unit"),
        F.min_by("country", F.struct("distance", "id")).alias("country"),
        F.min_by("lat", F.struct("distance", "id")).alias("lat"),
        F.min_by("lon", F.struct("distance", "id")).alias("lon"),
        F.min("distance").alias("distance"),
        F.count(F.lit(1)).alias("n"),
    )


def postcode_centroids(df: DataFrame, variants: list[str], limit: int = 10) -> DataFrame:
    """country, n, lat, lon of the rows with one of a postcode's spellings, most rows first."""
    return (
        df.filter(F.upper(F.trim("postcode")).isin(variants) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("country")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        .orderBy(F.desc("n"), "country")
        .limit(limit)
    )
