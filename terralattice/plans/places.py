"""Queries on places: scans, projections, filters, nearest-k, layers, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions.geo import point_in_box, radius_box
from terralattice.functions.text import contains_ci, starts_ci
from terralattice.operators import places as P
from terralattice.plans import geography as G
from terralattice.plans._register import (
    ADDRESSES_SQL,
    LAT,
    LAYER_SQL,
    LON,
    PLACES_SQL,
    query,
    sql_distance,
    sql_from_centre,
)

TAXONOMY = {
    "economy": ["goods", "economy"],
    "standard": ["goods", "standard"],
    "promo": ["goods", "offers", "promo"],
    "large": ["goods", "sizes", "large"],
    "medium": ["goods", "sizes", "medium"],
    "small": ["goods", "sizes", "small"],
}


@query("f02_conform", f"WITH {PLACES_SQL} SELECT id, name, CAST(NULL AS VARCHAR) AS operating_note FROM places")
def f02_conform(spark, sf_dir):
    from terralattice.sources.catalog import conform

    return conform(G.places(spark, sf_dir).select("id", "name"), {"name": "string", "operating_note": "string"})


@query(
    "f01_place_compact",
    f"""WITH {PLACES_SQL} SELECT id, name, category, round(confidence, 2) AS confidence,
    CASE WHEN status = 'permanently_closed' THEN 'low' WHEN confidence >= 75e-2 THEN 'high'
         WHEN confidence >= 5e-1 THEN 'moderate' ELSE 'low' END AS band,
    CASE status WHEN 'open' THEN 'open' WHEN 'temporarily_closed' THEN 'closed for now' WHEN 'permanently_closed' THEN 'closed' END AS status,
    brand, coalesce(len(websites) > 0, false) AS has_website, coalesce(len(phones) > 0, false) AS has_phone,
    round(lat, 6) AS lat, round(lon, 6) AS lon FROM places""",
)
def f01_place_compact(spark, sf_dir):
    return P.compact(G.places(spark, sf_dir))


_BOX = (-73.95, 40.65, -73.85, 40.75)


@query(
    "f03_bbox_filter",
    f"WITH {PLACES_SQL} SELECT id FROM places WHERE lon >= -7395e-2 AND lon <= -7385e-2 AND lat >= 4065e-2 AND lat <= 4075e-2",
)
def f03_bbox_filter(spark, sf_dir):
    from terralattice.functions.geo import box_meets

    return G.with_bbox(G.places(spark, sf_dir)).filter(box_meets("bbox", _BOX)).select("id")


@query(
    "f04_bbox_seam_split",
    f"""WITH {PLACES_SQL}, s AS (SELECT id, lat, CASE WHEN lon + 2539e-1 >= 180e0 THEN lon + 2539e-1 - 360e0 ELSE lon + 2539e-1 END AS x FROM places)
    SELECT id FROM s WHERE lat >= 406e-1 AND lat <= 408e-1 AND (x >= 1799e-1 OR x <= -1799e-1)""",
)
def f04_bbox_seam_split(spark, sf_dir):
    x = F.col("lon") + F.lit(253.9)
    shifted = G.places(spark, sf_dir).withColumn("lon", F.when(x >= 180, x - 360).otherwise(x))
    return shifted.filter(point_in_box(F.col("lat"), F.col("lon"), (179.9, 40.6, 180.1, 40.8))).select("id")


@query(
    "l01_nearest25",
    f"""WITH {PLACES_SQL} SELECT id, name, round({sql_from_centre()}, 0) AS distance FROM places
    WHERE {sql_from_centre()} <= 5000e0 ORDER BY distance, id LIMIT 25""",
)
def l01_nearest25(spark, sf_dir):
    return P.nearest(G.places(spark, sf_dir), LAT, LON, 5000.0).select("id", "name", "distance")


@query(
    "f08_radius_filter",
    f"WITH {PLACES_SQL} SELECT id, round({sql_from_centre()}, 1) AS distance FROM places WHERE {sql_from_centre()} <= 8000e0",
)
def f08_radius_filter(spark, sf_dir):
    return P.within(G.places(spark, sf_dir), LAT, LON, 8000.0).select("id", F.round("distance", 1).alias("distance"))


@query("f11_name_substring", f"WITH {PLACES_SQL} SELECT id, name FROM places WHERE name ILIKE '%RING%'")
def f11_name_substring(spark, sf_dir):
    return G.places(spark, sf_dir).filter(contains_ci(F.col("name"), "RING")).select("id", "name")


@query("f12_street_prefix", f"WITH {ADDRESSES_SQL} SELECT id, street FROM addresses WHERE street ILIKE 'mach%'")
def f12_street_prefix(spark, sf_dir):
    return G.addresses(spark, sf_dir).filter(starts_ci(F.col("street"), "mach")).select("id", "street")


@query(
    "f27_name_tokens_all",
    f"""WITH {PLACES_SQL} SELECT id, name FROM places WHERE name ILIKE '%bolt%' OR name ILIKE '%small ring%'
    OR (name ILIKE '%small%' AND name ILIKE '%ring%')""",
)
def f27_name_tokens_all(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.name_matches(F.col("name"), "small ring", "bolt")).select("id", "name")


@query(
    "f13_category_loose",
    f"""WITH {PLACES_SQL} SELECT id, category FROM places WHERE basic_category ILIKE '%rom%' OR category ILIKE '%rom%'
    OR list_contains(alternates, 'rom')""",
)
def f13_category_loose(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.category_loose("rom")).select("id", "category")


@query(
    "f14_category_strict",
    f"WITH {PLACES_SQL} SELECT id, category FROM places WHERE lower(category) IN ('large', 'medium', 'small', 'sizes')",
)
def f14_category_strict(spark, sf_dir):
    slugs = [*P.descendants(TAXONOMY, "sizes"), "sizes"]
    return G.places(spark, sf_dir).filter(P.category_strict(slugs)).select("id", "category")


@query("f15_category_exact", f"WITH {PLACES_SQL} SELECT id FROM places WHERE lower(category) = 'promo'")
def f15_category_exact(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.category_exact("Promo")).select("id")


@query(
    "f16_attribute_filters",
    f"WITH {PLACES_SQL} SELECT id FROM places WHERE confidence >= 2e-1 AND status IN ('open') AND brand ILIKE '%#2%'",
)
def f16_attribute_filters(spark, sf_dir):
    return (
        G.places(spark, sf_dir)
        .filter((F.col("confidence") >= 0.2) & F.col("status").isin(P.statuses("Open")) & contains_ci(F.col("brand"), "#2"))
        .select("id")
    )


@query(
    "f18_presence_filters",
    f"WITH {PLACES_SQL} SELECT id FROM places WHERE len(websites) > 0 AND NOT coalesce(len(phones) > 0, false)",
)
def f18_presence_filters(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.present(F.col("websites")) & ~P.present(F.col("phones"))).select("id")


_UNION = f"""WITH {PLACES_SQL}, {LAYER_SQL}, u AS (
  SELECT id, name, category, lat, lon, confidence, false AS supplementary FROM places
  UNION ALL SELECT id, name, category, lat, lon, NULL, true FROM layer)"""


def _union(spark, sf_dir):
    return P.with_layer(
        G.places(spark, sf_dir).select("id", "name", "category", "lat", "lon", "confidence"), G.layer(spark, sf_dir)
    )


@query("u01_union_layer", f"{_UNION} SELECT id, name, category, confidence, supplementary FROM u WHERE name IS NOT NULL OR supplementary")
def u01_union_layer(spark, sf_dir):
    return P.named(_union(spark, sf_dir)).select("id", "name", "category", "confidence", "supplementary")


@query(
    "j02_dedup_layer",
    f"""{_UNION} SELECT id, category, supplementary FROM u WHERE NOT supplementary OR NOT EXISTS (
      SELECT 1 FROM places p WHERE p.category = u.category AND {sql_distance('u.lat', 'u.lon', 'p.lat', 'p.lon')} <= 150e0)""",
)
def j02_dedup_layer(spark, sf_dir):
    return P.drop_doubles(_union(spark, sf_dir)).select("id", "category", "supplementary")


_ANCHORS = [(40.6, -74.0), (40.7, -73.9), (40.8, -73.8)]


def _box_sql(lat, lon, r):
    xmin, ymin, xmax, ymax = radius_box(lat, lon, r)
    return f"(lon BETWEEN {xmin!r}e0 AND {xmax!r}e0 AND lat BETWEEN {ymin!r}e0 AND {ymax!r}e0)"


@query(
    "u02_multi_anchor_union",
    f"WITH {PLACES_SQL} SELECT DISTINCT id FROM places WHERE " + " OR ".join(_box_sql(a, b, 7000.0) for a, b in _ANCHORS),
)
def u02_multi_anchor_union(spark, sf_dir):
    return P.in_boxes(G.places(spark, sf_dir), [radius_box(a, b, 7000.0) for a, b in _ANCHORS]).select("id")


@query(
    "j06_nearest_address_batch",
    f"""WITH {LAYER_SQL}, {ADDRESSES_SQL}, p AS (
      SELECT s.id AS id, a.id AS near_id, {sql_distance('s.lat', 's.lon', 'a.lat', 'a.lon')} AS d FROM layer s, addresses a)
    SELECT id, near_id, round(d, 1) AS distance FROM p WHERE d <= 5000e0
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, near_id) = 1""",
)
def j06_nearest_address_batch(spark, sf_dir):
    found = P.nearest_join(G.layer(spark, sf_dir), G.addresses(spark, sf_dir), 5000.0)
    return found.select("id", "near_id", F.round("distance", 1).alias("distance"))


@query(
    "w05_widening_topk",
    f"""WITH {LAYER_SQL}, {ADDRESSES_SQL}, p AS (
      SELECT s.id AS id, a.id AS near_id, {sql_distance('s.lat', 's.lon', 'a.lat', 'a.lon')} AS d FROM layer s, addresses a)
    SELECT id, near_id, CAST(row_number() OVER (PARTITION BY id ORDER BY d, near_id) AS INTEGER) AS rank FROM p WHERE d <= 5000e0
    QUALIFY rank <= 5""",
)
def w05_widening_topk(spark, sf_dir):
    return P.nearest_join(G.layer(spark, sf_dir), G.addresses(spark, sf_dir), 5000.0, k=5).select("id", "near_id", "rank")


@query(
    "j07_distance_matrix",
    f"""WITH {LAYER_SQL}, {PLACES_SQL} SELECT a.id AS origin, b.id AS destination,
    round({sql_distance('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 0) AS metres
    FROM layer a, places b WHERE a.id < 10 AND b.id < 10""",
)
def j07_distance_matrix(spark, sf_dir):
    from terralattice.functions.geo import haversine

    a = G.layer(spark, sf_dir).filter("id < 10").select(F.col("id").alias("origin"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    b = G.places(spark, sf_dir).filter("id < 10").select(F.col("id").alias("destination"), "lat", "lon")
    # The two stated sets of at most ten points each are the operator's input.
    return F.broadcast(a).crossJoin(b).select(
        "origin", "destination", F.round(haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")), 0).alias("metres")
    )


@query(
    "t10_within_distance",
    f"""WITH {PLACES_SQL}, p AS (SELECT id, {sql_from_centre()} AS d FROM places WHERE category = 'LARGE' AND {sql_from_centre()} <= 4000e0)
    SELECT id, round(d, 1) AS distance, d <= 2000e0 AS within FROM p ORDER BY d, id LIMIT 1""",
)
def t10_within_distance(spark, sf_dir):
    found = P.within(G.places(spark, sf_dir).filter(P.category_exact("large")), LAT, LON, 4000.0)
    return found.orderBy("distance", "id").limit(1).select("id", F.round("distance", 1).alias("distance"), (F.col("distance") <= 2000.0).alias("within"))


@query(
    "t15_place_details",
    f"""WITH {PLACES_SQL} SELECT id, name, category, brand FROM places WHERE name ILIKE '%ring%' AND {sql_from_centre()} <= 20000e0
    ORDER BY {sql_from_centre()}, id LIMIT 1""",
)
def t15_place_details(spark, sf_dir):
    found = P.within(G.places(spark, sf_dir).filter(contains_ci(F.col("name"), "ring")), LAT, LON, 20000.0)
    return found.orderBy("distance", "id").limit(1).select("id", "name", "category", "brand")


@query(
    "j12_id_lookup_across",
    f"""WITH {PLACES_SQL}, {LAYER_SQL}, u AS (
      SELECT id, 1 AS pri, 'place' AS kind, name FROM places UNION ALL SELECT id, 2, 'layer', name FROM layer
      UNION ALL SELECT n_nationkey, 3, 'division', n_name FROM nation)
    SELECT id, arg_min(kind, pri) AS kind, arg_min(coalesce(name, ''), pri) AS name FROM u WHERE id IN (1, 5, 77, 1000) GROUP BY id""",
)
def j12_id_lookup_across(spark, sf_dir):
    ids = [1, 5, 77, 1000]
    parts = [
        G.places(spark, sf_dir).select("id", F.lit(1).alias("pri"), F.lit("place").alias("kind"), "name"),
        G.layer(spark, sf_dir).select("id", F.lit(2).alias("pri"), F.lit("layer").alias("kind"), "name"),
        G.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(3).alias("pri"), F.lit("division").alias("kind"), F.col("n_name").alias("name")),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).filter(F.col("id").isin(ids))
    return every.groupBy("id").agg(F.min_by("kind", "pri").alias("kind"), F.min_by(F.coalesce("name", F.lit("")), "pri").alias("name"))
