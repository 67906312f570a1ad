"""Queries on areas, divisions, buildings, lines and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions import shape
from terralattice.operators import areas as A
from terralattice.operators import divisions as D
from terralattice.operators.places import within
from terralattice.plans import geography as G
from terralattice.plans._register import CELLS_SQL, LAT, LAYER_SQL, LON, PLACES_SQL, query, sql_distance, sql_from_centre, sql_lat, sql_lon


@query(
    "a01_area_mix",
    f"""WITH {PLACES_SQL}, c AS (SELECT category, count(*) AS n FROM places WHERE {sql_from_centre()} <= 12000e0 GROUP BY category),
    r AS (SELECT category, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, category) AS rank FROM c)
    SELECT CASE WHEN rank <= 4 THEN category ELSE 'other' END AS category, CAST(max(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n,
    round(CAST(sum(n) AS DOUBLE) / max(total), 3) AS share FROM r GROUP BY 1""",
)
def a01_area_mix(spark, sf_dir):
    return A.category_mix(within(G.places(spark, sf_dir), LAT, LON, 12000.0), top=4)


@query(
    "a02_counts_by_category",
    f"""WITH {PLACES_SQL} SELECT count(*) FILTER (WHERE category = 'LARGE') AS large, count(*) FILTER (WHERE category IN ('LARGE', 'SMALL')) AS sizes,
    count(*) FILTER (WHERE confidence >= 25e-2) AS sure FROM places WHERE {sql_from_centre()} <= 12000e0""",
)
def a02_counts_by_category(spark, sf_dir):
    df = within(G.places(spark, sf_dir), LAT, LON, 12000.0)
    return A.counts_by_predicate(
        df,
        {
            "large": F.col("category") == "LARGE",
            "sizes": F.col("category").isin("LARGE", "SMALL"),
            "sure": F.col("confidence") >= 0.25,
        },
    )


_CENTRES = [("a", 40.6, -74.0), ("b", 40.7, -73.9), ("c", 40.8, -73.8)]
_COUNTS = f"""WITH {PLACES_SQL}, centres AS (SELECT * FROM (VALUES ('a', 406e-1, -740e-1), ('b', 407e-1, -739e-1), ('c', 408e-1, -738e-1)) t(area, clat, clon)),
counts AS (SELECT area, category, count(*) AS n FROM centres, places
  WHERE {sql_distance('clat', 'clon', 'lat', 'lon')} <= 9000e0 GROUP BY area, category)"""


@query("a08_compare_areas", f"{_COUNTS} SELECT area, category, n FROM counts")
def a08_compare_areas(spark, sf_dir):
    return A.compare(G.places(spark, sf_dir), _CENTRES, 9000.0)


@query("a08_top_categories", f"{_COUNTS} SELECT category, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY category ORDER BY n DESC, category LIMIT 10")
def a08_top_categories(spark, sf_dir):
    return A.top_categories(A.compare(G.places(spark, sf_dir), _CENTRES, 9000.0))


@query("a09_density", f"{_COUNTS} SELECT area, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (pi() * 81e0), 3) AS per_km2 FROM counts GROUP BY area")
def a09_density(spark, sf_dir):
    counts = A.compare(G.places(spark, sf_dir), _CENTRES, 9000.0)
    return counts.groupBy("area").agg(F.sum("n").alias("n")).withColumn("per_km2", F.round(A.density(F.col("n"), 9000.0), 3))


@query(
    "a10_differentiators",
    f"""{_COUNTS}, f AS (SELECT a.area, c.category, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT area FROM counts) a
    CROSS JOIN (SELECT DISTINCT category FROM counts) c LEFT JOIN counts k ON a.area = k.area AND c.category = k.category)
    SELECT category, min(n) AS low, max(n) AS high, round(CAST(max(n) - min(n) AS DOUBLE) / max(n), 2) AS difference FROM f GROUP BY category""",
)
def a10_differentiators(spark, sf_dir):
    return A.differentiators(A.compare(G.places(spark, sf_dir), _CENTRES, 9000.0))


@query(
    "a11_weighted_verdict",
    f"""{_COUNTS}, v AS (SELECT area, category AS priority, n, CASE category WHEN 'LARGE' THEN 5e-1 ELSE 25e-2 END AS weight, category = 'PROMO' AS fewer
      FROM counts WHERE category IN ('LARGE', 'PROMO', 'SMALL')),
    s AS (SELECT area, weight * CASE WHEN fewer THEN CASE WHEN n = min(n) OVER w THEN 1e0 ELSE CAST(min(n) OVER w AS DOUBLE) / n END
      ELSE CASE WHEN max(n) OVER w = 0 THEN 1e0 ELSE CAST(n AS DOUBLE) / max(n) OVER w END END AS part FROM v WINDOW w AS (PARTITION BY priority)),
    t AS (SELECT area, round(sum(part), 3) AS score FROM s GROUP BY area)
    SELECT area, score, score = max(score) OVER () AND (SELECT count(*) FROM t u WHERE u.score = (SELECT max(score) FROM t)) = 1 AS winner FROM t""",
)
def a11_weighted_verdict(spark, sf_dir):
    counts = A.compare(G.places(spark, sf_dir), _CENTRES, 9000.0).filter(F.col("category").isin("LARGE", "PROMO", "SMALL"))
    values = counts.select(
        "area",
        F.col("category").alias("priority"),
        "n",
        F.when(F.col("category") == "LARGE", 0.5).otherwise(0.25).alias("weight"),
        (F.col("category") == "PROMO").alias("fewer"),
    )
    return A.weighted_verdict(values)


_BUILDINGS = f"""WITH b AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'residential' ELSE 'commercial' END END AS subtype,
    CASE WHEN s_acctbal >= 0 THEN s_acctbal / 100e0 END AS height, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 9 + 1 END AS num_floors,
    {sql_lat('s_suppkey')} AS lat, {sql_lon('s_suppkey')} AS lon, CAST(s_suppkey % 5 + 1 AS DOUBLE) * 1e-4 AS side FROM supplier)"""


@query(
    "a03_buildings_summary",
    f"""{_BUILDINGS}, c AS (SELECT *, side * side * 111320e0 * 111320e0 * cos(radians(407e-1)) AS area_m2 FROM b)
    SELECT count(*) AS n, round(sum(area_m2), 1) AS total_area, round(avg(area_m2), 1) AS mean_area,
    round(CAST(count(height) AS DOUBLE) / count(*), 3) AS height_known, round(CAST(count(num_floors) AS DOUBLE) / count(*), 3) AS floors_known,
    round(avg(height), 2) AS mean_height, round(avg(num_floors), 2) AS mean_floors, count(*) - count(subtype) AS uncategorized FROM c""",
)
def a03_buildings_summary(spark, sf_dir):
    df = G.footprints(spark, sf_dir).withColumn("area_m2", shape.area_m2(F.col("polygon"), F.lit(LAT)))
    return A.building_summary(df)


@query("a03_building_subtypes", f"{_BUILDINGS} SELECT subtype, count(*) AS n FROM b WHERE subtype IS NOT NULL GROUP BY subtype ORDER BY n DESC, subtype LIMIT 10")
def a03_building_subtypes(spark, sf_dir):
    return A.most_common(G.footprints(spark, sf_dir), "subtype")


@query(
    "g03_buildings_nearest",
    f"{_BUILDINGS} SELECT id, round({sql_from_centre()}, 1) AS distance FROM b WHERE {sql_from_centre()} <= 20000e0 ORDER BY {sql_from_centre()}, id LIMIT 10",
)
def g03_buildings_nearest(spark, sf_dir):
    df = G.footprints(spark, sf_dir)
    centre = shape.ring_centroid(F.get("polygon", F.lit(0)))
    at = df.withColumn("c", centre).select("id", F.col("c.y").alias("lat"), F.col("c.x").alias("lon"))
    found = within(at, LAT, LON, 20000.0)
    return found.orderBy(F.round("distance", 3), "id").limit(10).select("id", F.round("distance", 1).alias("distance"))


@query(
    "j03_admin_chain",
    f"""WITH {CELLS_SQL}, {LAYER_SQL}, a AS (SELECT id, name, xmin, ymin, xmax, ymax FROM cells UNION ALL SELECT -1, 'country', min(xmin), min(ymin), max(xmax), max(ymax) FROM cells),
    f AS (SELECT l.id AS id, c.id AS area_id, c.name AS name, (c.xmax - c.xmin) * (c.ymax - c.ymin) AS area FROM layer l JOIN a c ON l.lon > c.xmin AND l.lon < c.xmax AND l.lat > c.ymin AND l.lat < c.ymax)
    SELECT id, area_id, name, CAST(row_number() OVER (PARTITION BY id ORDER BY area, area_id) AS INTEGER) AS level FROM f""",
)
def j03_admin_chain(spark, sf_dir):
    """From the cell that holds a point to the country around all cells."""
    found = D.containing(G.layer(spark, sf_dir), D.with_country(G.cells(spark, sf_dir)))
    return D.chain(found).select("id", "area_id", "name", "level")


@query(
    "s16_grid_lookup",
    f"""WITH {CELLS_SQL}, {LAYER_SQL}, p AS (SELECT id, (floor(lon / 5e-2) + 5e-1) * 5e-2 AS x, (floor(lat / 5e-2) + 5e-1) * 5e-2 AS y FROM layer)
    SELECT p.id AS id, min(c.id) AS area_id FROM p LEFT JOIN cells c ON p.x > c.xmin AND p.x < c.xmax AND p.y > c.ymin AND p.y < c.ymax GROUP BY p.id""",
)
def s16_grid_lookup(spark, sf_dir):
    return D.painted_at(G.layer(spark, sf_dir), D.paint(G.cells(spark, sf_dir), size=0.05), 0.05)


@query(
    "j04_places_in_division",
    f"""WITH {CELLS_SQL}, {PLACES_SQL} SELECT p.id AS id, c.division_id AS division_id FROM places p
    JOIN cells c ON p.lon > c.xmin AND p.lon < c.xmax AND p.lat > c.ymin AND p.lat < c.ymax""",
)
def j04_places_in_division(spark, sf_dir):
    return D.containing(G.places(spark, sf_dir), G.cells(spark, sf_dir)).select("id", "division_id")


@query(
    "a06_division_extent",
    f"WITH {CELLS_SQL} SELECT division_id, round(min(xmin), 6) AS xmin, round(min(ymin), 6) AS ymin, round(max(xmax), 6) AS xmax, round(max(ymax), 6) AS ymax FROM cells GROUP BY division_id",
)
def a06_division_extent(spark, sf_dir):
    found = D.extents(G.cells(spark, sf_dir))
    return found.select("division_id", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


_QUERY_BOX = (-74.0, 40.55, -73.85, 40.75)


@query(
    "j05_division_overlap",
    f"""WITH {CELLS_SQL}, o AS (SELECT division_id, id,
      greatest(0e0, least(xmax, -7385e-2) - greatest(xmin, -740e-1)) * greatest(0e0, least(ymax, 4075e-2) - greatest(ymin, 4055e-2)) AS common,
      (xmax - xmin) * (ymax - ymin) AS area FROM cells)
    SELECT division_id, round(common / area, 3) AS share FROM o WHERE common > 1e-12
    QUALIFY row_number() OVER (PARTITION BY division_id ORDER BY round(common, 9) DESC, id) = 1""",
)
def j05_division_overlap(spark, sf_dir):
    box = shape.rectangle(*(F.lit(v) for v in _QUERY_BOX))
    return D.overlapping(G.cells(spark, sf_dir), F.array(box), _QUERY_BOX).select("division_id", F.round("share", 3).alias("share"))


@query(
    "j08_grid_paint",
    f"""WITH {CELLS_SQL}, g AS (SELECT x, y FROM (SELECT unnest(generate_series(-1482, -1470)) AS x), (SELECT unnest(generate_series(810, 820)) AS y))
    SELECT g.x AS gx, g.y AS gy, min(c.id) AS area_id FROM g JOIN cells c
      ON (g.x + 5e-1) * 5e-2 > c.xmin AND (g.x + 5e-1) * 5e-2 < c.xmax AND (g.y + 5e-1) * 5e-2 > c.ymin AND (g.y + 5e-1) * 5e-2 < c.ymax GROUP BY g.x, g.y""",
)
def j08_grid_paint(spark, sf_dir):
    return D.paint(G.cells(spark, sf_dir), size=0.05)


_LINES = f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS subtype, {sql_lat('o_orderkey')} AS lat, {sql_lon('o_orderkey')} AS lon,
    CAST(o_orderkey % 7 - 3 AS DOUBLE) * 1e-3 AS bend FROM orders),
v AS (SELECT id, subtype, lon AS ax, lat AS ay, lon + 4e-3 AS bx, lat + bend AS by_ FROM o
      UNION ALL SELECT id, subtype, lon + 4e-3, lat + bend, lon + 8e-3, lat FROM o),
t AS (SELECT *, least(1e0, greatest(0e0, ((-739e-1 - ax) * s * (bx - ax) * s + (407e-1 - ay) * (by_ - ay))
      / (pow((bx - ax) * s, 2) + pow(by_ - ay, 2)))) AS t FROM (SELECT *, cos(radians(407e-1)) AS s FROM v)),
p AS (SELECT id, subtype, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py, s FROM t),
n AS (SELECT id, subtype, arg_min(px, d2) AS px, arg_min(py, d2) AS py FROM
      (SELECT *, pow((-739e-1 - px) * s, 2) + pow(407e-1 - py, 2) AS d2 FROM p) GROUP BY id, subtype),
d AS (SELECT id, subtype, {sql_from_centre('py', 'px')} AS distance FROM n)"""


@query("g04_nearest_on_lines", f"{_LINES} SELECT id, round(distance, 1) AS distance FROM d WHERE distance <= 6000e0 ORDER BY round(distance, 3), id LIMIT 15")
def g04_nearest_on_lines(spark, sf_dir):
    df = G.waterways(spark, sf_dir).withColumn("distance", shape.distance_to_line(F.col("line"), F.lit(LAT), F.lit(LON)))
    found = df.filter("distance <= 6000").orderBy(F.round("distance", 3), "id").limit(15)
    return found.select("id", F.round("distance", 1).alias("distance"))


@query("w03_in_range_count", f"{_LINES} SELECT id, round(distance, 1) AS distance, count(*) OVER () AS total FROM d WHERE distance <= 4000e0 ORDER BY round(distance, 3), id LIMIT 10")
def w03_in_range_count(spark, sf_dir):
    from pyspark.sql import Window

    df = G.waterways(spark, sf_dir).withColumn("distance", shape.distance_to_line(F.col("line"), F.lit(LAT), F.lit(LON)))
    near = df.filter("distance <= 4000")
    # The count is an aggregate of its own, so no window gathers all rows in one task.
    total = near.agg(F.count(F.lit(1)).alias("total"))
    first = near.orderBy(F.round("distance", 3), "id").limit(10)
    return first.select("id", F.round("distance", 1).alias("distance")).crossJoin(F.broadcast(total))


@query(
    "f21_generalised_water",
    f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS subtype, o_orderpriority AS class, CAST(o_orderkey % 9 AS DOUBLE) / 20e0 AS span FROM orders)
    SELECT id FROM o WHERE coalesce(subtype = 'O', false) OR (coalesce(class IN ('5-LOW', '1-URGENT'), false) AND span >= 25e-2)""",
)
def f21_generalised_water(spark, sf_dir):
    o = G.table(spark, sf_dir, "orders")
    span = (F.col("o_orderkey") % 9).cast("double") / F.lit(20.0)
    open_water = F.coalesce(F.col("o_orderstatus") == "O", F.lit(False))
    wide = F.coalesce(F.col("o_orderpriority").isin("5-LOW", "1-URGENT"), F.lit(False)) & (span >= 0.25)
    return o.filter(open_water | wide).select(F.col("o_orderkey").alias("id"))
