"""Places: compact rows, filters, nearest-k, supplementary layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralattice.functions.geo import covering_box, covering_cells, grid_cell, haversine, point_in_box, split_at_seam
from terralattice.functions.text import contains_ci
from terralattice.sources.scratch import use_checkpoints

MAX_ROWS = 25
DEDUP_METRES = 150.0
#: Raw operating statuses and the labels shown for them.
STATUS_LABELS = {"open": "open", "temporarily_closed": "closed for now", "permanently_closed": "closed"}


def present(c: Column) -> Column:
    """A list that is there and not empty."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def confidence_band(confidence: Column, status: Column) -> Column:
    return (
        F.when(status == "permanently_closed", "low")
        .when(confidence >= 0.75, "high")
        .when(confidence >= 0.5, "moderate")
        .otherwise("low")
    )


def status_label(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.try_element_at(table, status)


def compact(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "name",
        "category",
        F.round("confidence", 2).alias("confidence"),
        confidence_band(F.col("confidence"), F.col("status")).alias("band"),
        status_label(F.col("status")).alias("status"),
        "brand",
        present(F.col("websites")).alias("has_website"),
        present(F.col("phones")).alias("has_phone"),
        F.round("lat", 6).alias("lat"),
        F.round("lon", 6).alias("lon"),
    )


def within(df: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows within a radius, with ``distance``; the box comes first so that it can reach the scan."""
    boxed = df.filter(point_in_box(F.col("lat"), F.col("lon"), covering_box(lat, lon, metres)))
    return boxed.withColumn("distance", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(
        F.col("distance") <= metres
    )


def nearest(df: DataFrame, lat: float, lon: float, metres: float, k: int = MAX_ROWS) -> DataFrame:
    """The k nearest by whole metres, ties by id."""
    found = within(df, lat, lon, metres).withColumn("distance", F.round("distance", 0))
    return found.orderBy("distance", "id").limit(min(k, MAX_ROWS))


def category_loose(text: str) -> Column:
    return (
        contains_ci(F.col("basic_category"), text)
        | contains_ci(F.col("category"), text)
        | F.coalesce(F.array_contains("alternates", text), F.lit(False))
    )


def descendants(taxonomy: dict[str, list[str]], slug: str) -> list[str]:
    """The slug and all whose path holds it."""
    return sorted(s for s, path in taxonomy.items() if s == slug or slug in path)


def category_strict(slugs: list[str]) -> Column:
    lowered = [s.lower() for s in slugs]
    return (
        F.coalesce(F.lower("basic_category").isin(lowered), F.lit(False))
        | F.coalesce(F.lower("category").isin(lowered), F.lit(False))
        | F.coalesce(F.arrays_overlap("alternates", F.array(*map(F.lit, slugs))), F.lit(False))
    )


def category_exact(text: str) -> Column:
    return F.lower("category") == text.lower()


def statuses(wanted: str) -> list[str]:
    """Raw statuses behind a label or a raw value."""
    found = [raw for raw, label in STATUS_LABELS.items() if wanted.lower() in (raw, label)]
    if not found:
        raise ValueError(f"unknown status {wanted!r}")
    return found


def all_tokens(name: Column, query: str) -> Column:
    """Every word of the query stands in the name; at most eight words, at least two, else never."""
    words = query.lower().split()[:8]
    if len(words) < 2:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (contains_ci(name, w) for w in words))


def name_matches(name: Column, whole: str, residual: str) -> Column:
    return contains_ci(name, residual) | contains_ci(name, whole) | all_tokens(name, whole)


def with_layer(primary: DataFrame, layer: DataFrame) -> DataFrame:
    """Union by name; rows of the layer are marked and lack what only places have."""
    return primary.withColumn("supplementary", F.lit(False)).unionByName(
        layer.withColumn("supplementary", F.lit(True)), allowMissingColumns=True
    )


def named(df: DataFrame) -> DataFrame:
    return df.filter(F.col("name").isNotNull() | F.col("supplementary"))


def drop_doubles(df: DataFrame, metres: float = DEDUP_METRES) -> DataFrame:
    """Drops layer rows with a primary row of the same category nearby.  The grid cell keeps it an equi-join."""
    primary = df.filter(~F.col("supplementary")).select(
        F.col("category").alias("_c"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        grid_cell(F.col("lat"), F.col("lon"), metres).alias("_cell"),
    )
    layer = df.filter("supplementary")
    keyed = layer.select("id", "category", "lat", "lon").withColumn(
        "_cell", F.explode(covering_cells(F.col("lat"), F.col("lon"), metres, metres))
    )
    doubles = (
        keyed.join(primary, (keyed["category"] == primary["_c"]) & (keyed["_cell"] == primary["_cell"]))
        .filter(haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= metres)
        .select(F.col("id").alias("_double"))
        .distinct()
    )
    kept = layer.join(doubles, F.col("id") == F.col("_double"), "left_anti")
    return df.filter(~F.col("supplementary")).unionByName(kept)


def pairs_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """id, near_id, distance of all pairs within a radius.  Both sides meet on grid cells of its size: no cross join."""
    a = left.select("id", "lat", "lon").withColumn("_cell", F.explode(covering_cells(F.col("lat"), F.col("lon"), metres, metres)))
    b = right.select(
        F.col("id").alias("near_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        grid_cell(F.col("lat"), F.col("lon"), metres).alias("_cell"),
    )
    return (
        a.join(b, "_cell")
        .withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
        .filter(F.col("distance") <= metres)
        .select("id", "near_id", "distance")
    )


def nearest_join(left: DataFrame, right: DataFrame, metres: float, k: int = 1, first: float = 200.0, step: float = 5.0) -> DataFrame:
    """For every left row (id, lat, lon) its k nearest right rows within a radius: near_id, distance, rank.

    Rings widen from ``first`` by ``step`` up to the radius; only rows with fewer than k neighbours go on, so most never see the widest ring.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("distance", "near_id")
    spark = left.sparkSession
    use_checkpoints(spark)
    todo, found, reach = left.select("id", "lat", "lon"), None, min(first, metres)
    while True:
        ranked = pairs_within(todo, right, reach).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if reach >= metres:
            return ranked if found is None else found.unionAll(ranked)
        ranked = ranked.checkpoint()
        enough = ranked.filter(F.col("rank") == k).select("id")
        done = ranked.join(enough, "id", "left_semi")
        found = done if found is None else found.unionAll(done)
        todo, reach = todo.join(enough, "id", "left_anti").checkpoint(), min(reach * step, metres)


def in_boxes(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """One bounded scan per box, together; rows in several boxes come once."""
    parts = [df.filter(point_in_box(F.col("lat"), F.col("lon"), b)) for box in boxes for b in split_at_seam(box)]
    return reduce(DataFrame.unionAll, parts).dropDuplicates(["id"])


def confident(least: float) -> Column:
    """Confidence at least this; the bound lies in 0..1, and an unknown confidence fails."""
    if not 0 <= least <= 1:
        raise ValueError(f"a confidence lies between 0 and 1, not at {least}")
    return F.coalesce(F.col("confidence") >= least, F.lit(False))


def presence(c: Column, wanted: bool | None) -> Column:
    """A list that is there (True), is not (False), or either (None)."""
    return F.lit(True) if wanted is None else present(c) if wanted else ~present(c)


def kind_contains(text: str, columns: tuple[str, ...] = ("subtype", "class")) -> Column:
    """A text inside any of the kinds of a feature."""
    return reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(c), text), F.lit(False)) for c in columns))


def generalised_water(span: Column, dimension: Column | None = None) -> Column:
    """Oceans, and seas and straits that are areas at least a quarter of a degree wide; unknown kinds are none."""
    area = F.lit(True) if dimension is None else dimension == 2
    large = F.coalesce(F.col("class").isin("sea", "strait"), F.lit(False)) & (span >= 0.25) & area
    return F.coalesce(F.col("subtype") == "ocean", F.lit(False)) | large


def unless_unsatisfiable(df: DataFrame, subtype: str | None) -> DataFrame:
    """Oceans never lie at a distance, so a search for them alone is empty, and no scan is made."""
    return df.filter(F.lit(False)) if subtype == "ocean" else df


def checked_point(lat: float, lon: float) -> tuple[float, float]:
    """A finite latitude in -90..90 and longitude in -180..180; others are errors that name the field."""
    import math

    for name, value, most in (("lat", lat, 90.0), ("lon", lon, 180.0)):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or abs(value) > most:
            raise ValueError(f"{name} must be a finite number within {most:g}, not {value!r}")
    return float(lat), float(lon)


def planar_nearest(df: DataFrame, lat: float, lon: float, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first rows by planar nearness, name and id; and one row that tells whether there were more."""
    import math

    dx, dy = (F.col("lon") - lon) * math.cos(math.radians(lat)), F.col("lat") - lat
    rows = df.withColumn("_near", dy * dy + dx * dx).orderBy("_near", "name", "id")
    more = rows.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("capped"))
    return rows.limit(most).drop("_near"), more


def truncated(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of an ordered frame, and one row that tells, by one row more, whether some are left out."""
    return df.limit(most), df.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in an order."""
    from pyspark.sql import Window

    ranked = df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_first = 1").drop("_first")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in an order, without a task that sees them all: sorted ranges, counted, and each numbered from its offset.

    The ranges are checkpointed, so that counting and numbering see the same ones.
    """
    from pyspark.sql import Window

    use_checkpoints(df.sparkSession)
    part, inside, before = (f"_{name}_{x}" for x in ("part", "inside", "before"))
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    # A row per range, so one task may add them up.
    sums = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(sums, F.lit(0)).alias(before))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    every = ranged.withColumn(inside, rank).join(F.broadcast(offsets), part)
    return every.withColumn(name, F.col(before) + F.col(inside)).drop(part, inside, before)
