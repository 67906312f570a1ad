"""Answer-shaping: budgets, grades, notes, checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIRMED, STRETCHED = 1.15, 1.5


def grade(actual: Column, claimed: Column) -> Column:
    """A claimed distance or time against the measured one."""
    return (
        F.when(actual.isNull(), "unverifiable")
        .when(actual <= claimed * CONFIRMED, "confirmed")
        .when(actual <= claimed * STRETCHED, "stretched")
        .otherwise("false")
    )


def grade_count(actual: Column, claimed: Column, cap: int) -> Column:
    """A claimed number; a count that stopped at its cap cannot refute a larger claim."""
    return (
        F.when(actual >= claimed, "confirmed")
        .when(actual >= cap, "unverifiable")
        .when(actual >= F.greatest(F.lit(1), claimed / 2), "stretched")
        .otherwise("false")
    )


def trust_note(confidence: Column, status: Column) -> Column:
    return (
        F.when(status == "permanently_closed", "reported closed")
        .when(status == "temporarily_closed", "reported closed for now; check before going")
        .when(confidence.isNull() | (confidence < 0.5), "weak evidence; check before going")
        .when(confidence < 0.75, "fair evidence")
        .otherwise("good evidence")
    )


#: Fields that a row gives up, in this order, where it alone is over the budget; fixed values.
OPTIONAL_FIELDS = ("confidence", "operating_status", "category", "basic_category", "trust_note")


def json_length(columns: list[str]) -> Column:
    """Characters of a row's JSON with ', ' and ': ' between its parts, nulls left out."""
    there = F.size(F.filter(F.array(*(F.col(c).isNotNull() for c in columns)), lambda x: x))
    # to_json writes no blanks: one comes after each colon and each comma.
    return F.length(F.to_json(F.struct(*columns))) + F.greatest(2 * there - 1, F.lit(0))


def compact_json(columns: list[str], df: DataFrame) -> Column:
    """A row as JSON without its nulls and empty lists."""
    filled = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c)) if df.schema[c].dataType.typeName() == "array" else F.col(c)
    return F.to_json(F.struct(*(filled(c).alias(c) for c in columns)))


def fit_budget(df: DataFrame, order: list[str], tokens: int, by: list[str] | None = None) -> DataFrame:
    """The leading rows whose JSON list fits the budget of four characters a token, one at least.

    Where the first row alone is too long, it gives up its optional fields, one after another, until it fits.  Rows are those of one ranked
    answer, or of one per key in ``by``.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    ranked = w.orderBy(*order)
    size = json_length(df.columns)
    sized = df.withColumns({"_n": F.row_number().over(ranked), "_size": size})
    # Brackets, the rows, and ', ' between them.
    kept = sized.withColumn("_sum", F.sum(F.col("_size") + 2).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).filter(
        (F.floor(F.col("_sum") / 4) <= tokens) | (F.col("_n") == 1)
    )
    for field in [f for f in OPTIONAL_FIELDS if f in df.columns]:
        over = F.floor((F.col("_size") + 2) / 4) > tokens
        shorter = F.when(over, F.lit(None)).otherwise(F.col(field))
        kept = kept.withColumn(field, shorter).withColumn("_size", json_length(df.columns))
    return kept.select(*df.columns)


def truncated(c: Column, most: int = 5) -> tuple[Column, Column]:
    """A list's first entries and how many it lost."""
    return F.slice(c, 1, most), F.greatest(F.size(c) - most, F.lit(0))


def checklist(nearest: DataFrame, near: float, far: float) -> DataFrame:
    """need, metres, verdict: covered within ``near``, weak within ``far``, else unknown."""
    verdict = F.when(F.col("metres") <= near, "covered").when(F.col("metres") <= far, "weak").otherwise("unknown")
    return nearest.withColumn("verdict", verdict)


#: Words of a context that tell how someone moves, in the order in which they are looked for; fixed values.
MOBILITY = {
    "walk": ("no car", "without a car", "car-free", "carless", "car free"),
    "cycle": ("bike", "cycle", "cycling", "bicycle", "biking"),
    "drive": ("car", "drive", "driving"),
}


def mobility(context: Column) -> Column:
    """walk, cycle or drive by whole words of a context; walk if it says nothing."""
    out = F
    for mode, words in MOBILITY.items():
        said = F.lower(context).rlike("(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])")
        out = out.when(said, mode)
    return out.otherwise("walk")


def straight_minutes(metres: Column, mode: str) -> Column:
    """Minutes along a straight line at the mode's speed."""
    return metres / F.lit({"walk": 1.4, "cycle": 4.2, "drive": 8.0}[mode] * 60)


def feature(properties: list[str], lat: Column, lon: Column) -> Column:
    """A point as the text of a GeoJSON feature; properties that are null are left out."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates")).alias("geometry"),
            F.struct(*properties).alias("properties"),
        )
    )


def track_point(lat: Column, lon: Column, name: Column) -> Column:
    """A point as a GPX way point."""
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.format_string('<wpt lat="%.6f" lon="%.6f"><name>', lat, lon), safe, F.lit("</name></wpt>"))


def map_link(lat: Column, lon: Column, zoom: int = 17) -> Column:
    return F.format_string(f"geo:%.6f,%.6f?z={zoom}", lat, lon)
