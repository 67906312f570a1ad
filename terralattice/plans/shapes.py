"""Queries on geometry, tiles, answers and the optional event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions import geo, shape
from terralattice.operators import answers as W
from terralattice.operators import areas as A
from terralattice.operators.places import within
from terralattice.plans import geography as G
from terralattice.plans._register import ADDRESSES_SQL, LAT, LAYER_SQL, LON, PLACES_SQL, query, sql_distance, sql_from_centre, sql_lat, sql_lon


@query(
    "g07_points",
    f"""WITH {LAYER_SQL} SELECT id, round({sql_from_centre()}, 1) AS distance,
    round(((degrees(atan2(sin(radians(lon - -739e-1)) * cos(radians(lat)), cos(radians(407e-1)) * sin(radians(lat)) - sin(radians(407e-1)) * cos(radians(lat)) * cos(radians(lon - -739e-1)))) + 360e0) % 360e0), 3) AS bearing
    FROM layer""",
)
def g07_points(spark, sf_dir):
    a, b, lat, lon = F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")
    return G.layer(spark, sf_dir).select(
        "id", F.round(geo.haversine(a, b, lat, lon), 1).alias("distance"), F.round(geo.bearing(a, b, lat, lon), 3).alias("bearing")
    )


def _to_sql(lat, lon, heading, metres):
    """lat, lon of the point at a heading and distance."""
    r = f"({metres} / 6371000e0)"
    to = f"asin(sin(radians({lat})) * cos({r}) + cos(radians({lat})) * sin({r}) * cos(radians({heading})))"
    turn = f"atan2(sin(radians({heading})) * sin({r}) * cos(radians({lat})), cos({r}) - sin(radians({lat})) * sin({to}))"
    return f"degrees({to})", f"({lon} + degrees({turn}))"


_Y, _X = _to_sql("lat", "lon", "CAST(id % 360 AS DOUBLE)", "1000e0")


@query(
    "g07_destination_round_trip",
    f"""WITH {LAYER_SQL}, d AS (SELECT id, lat, lon, {_Y} AS y, {_X} AS x FROM layer),
    m AS (SELECT *, cos(radians(y)) * cos(radians(x - lon)) AS bx, cos(radians(y)) * sin(radians(x - lon)) AS by_ FROM d)
    SELECT id, round(y, 7) AS to_lat, round(x, 7) AS to_lon,
      round(degrees(atan2(sin(radians(lat)) + sin(radians(y)), sqrt(pow(cos(radians(lat)) + bx, 2) + by_ * by_))), 7) AS mid_lat,
      round(lon + degrees(atan2(by_, cos(radians(lat)) + bx)), 7) AS mid_lon,
      round({sql_distance('lat', 'lon', 'y', 'x')}, 2) AS there FROM m""",
)
def g07_destination_round_trip(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    y, x = geo.destination(lat, lon, (F.col("id") % 360).cast("double"), F.lit(1000.0))
    df = G.layer(spark, sf_dir).withColumns({"y": y, "x": x})
    my, mx = geo.midpoint(lat, lon, F.col("y"), F.col("x"))
    return df.select(
        "id",
        F.round("y", 7).alias("to_lat"),
        F.round("x", 7).alias("to_lon"),
        F.round(my, 7).alias("mid_lat"),
        F.round(mx, 7).alias("mid_lon"),
        F.round(geo.haversine(lat, lon, F.col("y"), F.col("x")), 2).alias("there"),
    )


@query(
    "g02_measures",
    f"""SELECT s_suppkey AS id, round(pow(CAST(s_suppkey % 5 + 1 AS DOUBLE) * 1e-4, 2) * 1e8, 4) AS area,
    round({sql_lat('s_suppkey')}, 6) AS lat, round({sql_lon('s_suppkey')}, 6) AS lon FROM supplier""",
)
def g02_measures(spark, sf_dir):
    ring = F.get("polygon", F.lit(0))
    centre = shape.ring_centroid(ring)
    return G.footprints(spark, sf_dir).select(
        "id",
        F.round(shape.area(F.col("polygon")) * 1e8, 4).alias("area"),
        F.round(centre["y"], 6).alias("lat"),
        F.round(centre["x"], 6).alias("lon"),
    )


@query(
    "g08_line_length",
    f"""WITH o AS (SELECT o_orderkey AS id, {sql_lat('o_orderkey')} AS lat, {sql_lon('o_orderkey')} AS lon, CAST(o_orderkey % 7 - 3 AS DOUBLE) * 1e-3 AS bend FROM orders)
    SELECT id, round({sql_distance('lat', 'lon', 'lat + bend', 'lon + 4e-3')} + {sql_distance('lat + bend', 'lon + 4e-3', 'lat', 'lon + 8e-3')}, 2) AS metres,
    round(lon + 8e-3, 6) AS xmax, round(greatest(lat, lat + bend), 6) AS ymax FROM o""",
)
def g08_line_length(spark, sf_dir):
    box = shape.bbox(F.col("line"))
    return G.waterways(spark, sf_dir).select(
        "id", F.round(shape.length_m(F.col("line")), 2).alias("metres"), F.round(box["xmax"], 6).alias("xmax"), F.round(box["ymax"], 6).alias("ymax")
    )


_RING_Y, _RING_X = _to_sql("lat", "lon", "(i * 1125e-2)", "CAST(id % 7 + 1 AS DOUBLE) * 100e0")


@query(
    "g10_buffer_ring",
    f"""WITH {LAYER_SQL}, r AS (SELECT id, lat, lon, unnest(generate_series(0, 31)) AS i FROM layer)
    SELECT id, CAST(i AS INTEGER) AS corner, round({_RING_Y}, 7) AS y, round({_RING_X}, 7) AS x FROM r""",
)
def g10_buffer_ring(spark, sf_dir):
    metres = (F.col("id") % 7 + 1).cast("double") * F.lit(100.0)
    ring = shape.buffer_ring(F.col("lat"), F.col("lon"), metres)
    corners = G.layer(spark, sf_dir).select("id", F.posexplode(ring).alias("corner", "v"))
    return corners.select("id", "corner", F.round("v.y", 7).alias("y"), F.round("v.x", 7).alias("x"))


@query(
    "g11_convex_hull",
    f"""WITH RECURSIVE {ADDRESSES_SQL}, p AS (SELECT DISTINCT country AS g, round((lon + 741e-1) * 25000e0) AS x, round((lat - 405e-1) * 25000e0) AS y FROM addresses),
    s AS (SELECT g, min({{'x': x, 'y': y}}) AS o FROM p GROUP BY g),
    w(g, o, c, a, i) AS (SELECT g, o, o, -pi() / 2e0, 0 FROM s UNION ALL
      SELECT t.g, t.o, n.c, n.a, t.i + 1 FROM w t, LATERAL (SELECT arg_min({{'x': p.x, 'y': p.y}}, {{'turn': turn, 'far': -far}}) AS c, arg_min(ang, {{'turn': turn, 'far': -far}}) AS a FROM
        (SELECT p.x, p.y, atan2(p.y - t.c.y, p.x - t.c.x) AS ang, round((atan2(p.y - t.c.y, p.x - t.c.x) - t.a + 4e0 * pi() + 1e-9) % (2e0 * pi()), 8) AS turn, pow(p.x - t.c.x, 2) + pow(p.y - t.c.y, 2) AS far
         FROM p WHERE p.g = t.g AND (p.x <> t.c.x OR p.y <> t.c.y)) p) n WHERE t.i = 0 OR t.c <> t.o),
    h AS (SELECT g, i, c, lead(c) OVER (PARTITION BY g ORDER BY i) AS d FROM w)
    SELECT g AS country, CAST(count(*) AS INTEGER) AS corners, round(abs(sum(c.x * d.y - d.x * c.y)) / 2e0, 1) AS area FROM h WHERE d IS NOT NULL GROUP BY g""",
)
def g11_convex_hull(spark, sf_dir):
    # In steps of the test geography's grid, so that corners on one line are so exactly.
    x, y = F.round((F.col("lon") + 74.1) * 25000), F.round((F.col("lat") - 40.5) * 25000)
    hull = shape.hulls(G.addresses(spark, sf_dir).select("country", x.alias("x"), y.alias("y")), "country", "x", "y")
    return hull.select("country", F.size("hull").alias("corners"), F.round(shape.area(F.array("hull")), 1).alias("area"))


@query(
    "g14_simplify_line",
    f"""WITH o AS (SELECT o_orderkey AS id, CAST(abs(o_orderkey % 7 - 3) AS DOUBLE) * 1e-3 AS bend FROM orders)
    SELECT id, CASE WHEN bend > 15e-4 THEN 3 ELSE 2 END AS vertices, CASE WHEN bend > 15e-4 THEN 0e0 ELSE round(bend * 111320e0, 2) END AS deviation FROM o""",
)
def g14_simplify_line(spark, sf_dir):
    df = G.waterways(spark, sf_dir).withColumn("short", shape.simplified_within(0.0015)(F.col("line")))
    off = F.transform("line", lambda v: shape.planar_distance(F.col("short"), v["x"], v["y"]))
    return df.select("id", F.size("short").alias("vertices"), F.round(F.array_max(off) * shape.METRES_PER_DEGREE, 2).alias("deviation"))


@query(
    "g14_simplify_to_count",
    "SELECT o_orderkey AS id, CAST(least(3, 2 + o_orderkey % 2) AS INTEGER) AS vertices FROM orders",
)
def g14_simplify_to_count(spark, sf_dir):
    short = shape.simplified(F.when(F.col("id") % 2 == 1, 3).otherwise(2))(F.col("line"))
    return G.waterways(spark, sf_dir).select("id", F.size(short).alias("vertices"))


_LINE_SQL = f"""WITH o AS (SELECT o_orderkey AS id, {sql_lat('o_orderkey')} AS lat, {sql_lon('o_orderkey')} AS lon, CAST(o_orderkey % 7 - 3 AS DOUBLE) * 1e-3 AS bend FROM orders)
    SELECT id, 3 AS n, round(lon, 6) AS x0, round(lat + bend, 6) AS y1, round(lon + 8e-3, 6) AS x2 FROM o"""


def _read_back(df, line):
    at = lambda i: F.get(line, F.lit(i))
    return df.select("id", F.size(line).alias("n"), F.round(at(0)["x"], 6).alias("x0"), F.round(at(1)["y"], 6).alias("y1"), F.round(at(2)["x"], 6).alias("x2"))


@query("e17_wkt_lines", _LINE_SQL)
def e17_wkt_lines(spark, sf_dir):
    """Lines written as text and read again."""
    df = G.waterways(spark, sf_dir).withColumn("text", shape.wkt_line(F.col("line")))
    return _read_back(df, shape.parse_wkt_line(F.col("text")))


@query("e17_geojson_lines", _LINE_SQL)
def e17_geojson_lines(spark, sf_dir):
    df = G.waterways(spark, sf_dir).withColumn("text", shape.geojson_line(F.col("line")))
    return _read_back(df, shape.parse_geojson_line(F.col("text")))


@query("e17_wkb_lines", _LINE_SQL)
def e17_wkb_lines(spark, sf_dir):
    df = G.waterways(spark, sf_dir).withColumn("shape", shape.decode_wkb(shape.wkb_line(F.col("line"))))
    return _read_back(df, F.col("shape.parts")[0][0])


@query(
    "g19_unwrap_longitude",
    f"WITH {LAYER_SQL} SELECT id, round(lon + 253.9e0 - 180e0, 6) AS past_seam FROM layer".replace("253.9e0", "2539e-1"),
)
def g19_unwrap_longitude(spark, sf_dir):
    wrapped = geo.wrap_longitude(F.col("lon") + F.lit(253.9))
    return G.layer(spark, sf_dir).select("id", F.round(geo.unwrap_longitude(wrapped, F.lit(180.0)) - 180, 6).alias("past_seam"))


@query(
    "a19_circular_mean",
    f"WITH {LAYER_SQL} SELECT round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 6) AS lon FROM layer",
)
def a19_circular_mean(spark, sf_dir):
    return G.layer(spark, sf_dir).agg(F.round(geo.circular_mean(F.col("lon")), 6).alias("lon"))


@query(
    "e26_claims_grade",
    f"""WITH {PLACES_SQL}, d AS (SELECT category, min({sql_from_centre()}) AS m FROM places GROUP BY category)
    SELECT category, CASE WHEN m <= 115e0 THEN 'confirmed' WHEN m <= 150e0 THEN 'stretched' ELSE 'false' END AS grade FROM d""",
)
def e26_claims_grade(spark, sf_dir):
    d = G.places(spark, sf_dir).groupBy("category").agg(
        F.min(geo.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))).alias("m")
    )
    return d.select("category", W.grade(F.col("m"), F.lit(100.0)).alias("grade"))


@query(
    "t12_needs_checklist",
    f"""WITH {PLACES_SQL}, d AS (SELECT category AS need, min({sql_from_centre()}) AS m FROM places WHERE category IN ('LARGE', 'PROMO') GROUP BY 1)
    SELECT need, CASE WHEN m <= 400e0 THEN 'covered' WHEN m <= 1200e0 THEN 'weak' ELSE 'unknown' END AS verdict, round(m / 84e0, 2) AS minutes FROM d""",
)
def t12_needs_checklist(spark, sf_dir):
    d = (
        G.places(spark, sf_dir)
        .filter(F.col("category").isin("LARGE", "PROMO"))
        .groupBy(F.col("category").alias("need"))
        .agg(F.min(geo.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))).alias("metres"))
    )
    return W.checklist(d, 400.0, 1200.0).select("need", "verdict", F.round(W.straight_minutes(F.col("metres"), "walk"), 2).alias("minutes"))


@query(
    "t14_trust_note",
    f"""WITH {PLACES_SQL} SELECT id, CASE WHEN status = 'permanently_closed' THEN 'reported closed' WHEN status = 'temporarily_closed' THEN 'reported closed for now; check before going'
    WHEN confidence < 5e-1 THEN 'weak evidence; check before going' WHEN confidence < 75e-2 THEN 'fair evidence' ELSE 'good evidence' END AS note FROM places""",
)
def t14_trust_note(spark, sf_dir):
    return G.places(spark, sf_dir).select("id", W.trust_note(F.col("confidence"), F.col("status")).alias("note"))


_FIT = f"""WITH {PLACES_SQL}, f AS (SELECT id, name, category, round(confidence, 2) AS confidence, CAST(round({sql_from_centre()}, 0) AS BIGINT) AS distance FROM places
      WHERE {sql_from_centre()} <= 5000e0 ORDER BY distance, id LIMIT 25),
    j AS (SELECT *, length('{{"id": ' || id || ', "name": "' || name || '", "category": "' || category || '", "confidence": ' || confidence || ', "distance": ' || distance || '}}') AS n FROM f),
    s AS (SELECT *, 2 + sum(n + 2) OVER (ORDER BY distance, id) - 2 AS total, row_number() OVER (ORDER BY distance, id) AS r FROM j)"""


@query("l06_budget_fit", f"{_FIT} SELECT id, name, category, confidence, distance FROM s WHERE total // 4 <= 200 OR r = 1")
def l06_budget_fit(spark, sf_dir):
    return W.fit_budget(_ranked(spark, sf_dir), ["distance", "id"], 200)


@query(
    "l06_budget_strip",
    f"{_FIT} SELECT id, name, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS confidence, distance FROM s WHERE r = 1",
)
def l06_budget_strip(spark, sf_dir):
    """A budget below one row's size: one row stays and loses its optional fields, in their order, until it fits."""
    return W.fit_budget(_ranked(spark, sf_dir), ["distance", "id"], 11)


def _ranked(spark, sf_dir):
    found = within(G.places(spark, sf_dir), LAT, LON, 5000.0)
    return (
        found.select("id", "name", "category", F.round("confidence", 2).alias("confidence"), F.round("distance", 0).cast("long").alias("distance"))
        .orderBy("distance", "id")
        .limit(25)
    )


@query(
    "l07_array_truncate",
    "SELECT c_mktsegment || CAST(c_nationkey AS VARCHAR) AS area, least(count(*), 5) AS kept, greatest(count(*) - 5, 0) AS omitted FROM customer GROUP BY 1",
)
def l07_array_truncate(spark, sf_dir):
    area = F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("area")
    kept, omitted = W.truncated(F.col("l"))
    return G.table(spark, sf_dir, "customer").groupBy(area).agg(F.collect_list("c_name").alias("l")).select(
        "area", F.size(kept).cast("long").alias("kept"), omitted.cast("long").alias("omitted")
    )


@query(
    "a22_nearest_rank_p95",
    "SELECT event_type, quantile_disc(value, 95e-2) AS p95 FROM events GROUP BY event_type",
)
def a22_nearest_rank_p95(spark, sf_dir):
    found = A.nearest_rank(G.table(spark, sf_dir, "events"), "event_type", "value", 0.95)
    return found.withColumnRenamed("value", "p95")


@query(
    "x01_event_windows",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def x01_event_windows(spark, sf_dir):
    from terralattice.streaming.events import hourly

    found = hourly(G.table(spark, sf_dir, "events"))
    return found.select("hour", "event_type", "n", F.round("total", 4).alias("total"))
