"""Queries on predicates, nested columns, ranking, sets and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions import geo
from terralattice.functions import shape
from terralattice.functions import text as X
from terralattice.operators import areas as A
from terralattice.operators import changes as C
from terralattice.operators import graph as R
from terralattice.operators import names as N
from terralattice.operators import places as P
from terralattice.plans import geography as G
from terralattice.plans._register import ADDRESSES_SQL, CELLS_SQL, LAT, LAYER_SQL, LON, PLACES_SQL, query, sql_distance, sql_from_centre, sql_lat, sql_lon

_WATER = """w AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'ocean' WHEN 1 THEN NULL ELSE 'lake' END AS subtype,
  CASE o_orderkey % 3 WHEN 0 THEN 'sea' WHEN 1 THEN 'strait' END AS class, CAST(o_orderkey % 9 AS DOUBLE) / 20e0 AS span, o_orderkey % 4 AS dim, o_orderstatus AS status FROM orders)"""


def _water(spark, sf_dir):
    k = F.col("o_orderkey")
    return G.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 5 == 0, "ocean").when(k % 5 > 1, "lake").alias("subtype"),
        F.when(k % 3 == 0, "sea").when(k % 3 == 1, "strait").alias("class"),
        ((k % 9).cast("double") / F.lit(20.0)).alias("span"),
        (k % 4).alias("dim"),
    )


@query(
    "f21_generalised_areas",
    f"WITH {_WATER} SELECT id FROM w WHERE coalesce(subtype = 'ocean', false) OR (coalesce(class IN ('sea', 'strait'), false) AND span >= 25e-2 AND dim = 2)",
)
def f21_generalised_areas(spark, sf_dir):
    return _water(spark, sf_dir).filter(P.generalised_water(F.col("span"), F.col("dim"))).select("id")


@query("f22_unsatisfiable", f"WITH {_WATER} SELECT id FROM w WHERE false")
def f22_unsatisfiable(spark, sf_dir):
    return P.unless_unsatisfiable(_water(spark, sf_dir), "ocean").select("id")


@query("f23_kind_substring", f"WITH {_WATER} SELECT id FROM w WHERE coalesce(subtype ILIKE '%AK%', false) OR coalesce(class ILIKE '%AK%', false) OR coalesce(class ILIKE '%zz%', false)")
def f23_kind_substring(spark, sf_dir):
    return _water(spark, sf_dir).filter(P.kind_contains("AK")).select("id")


_ROADS = """r AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'rail' END AS subtype,
  (ARRAY['motorway', 'footway', 'residential', NULL, 'trunk', 'path'])[l_partkey % 6 + 1] AS class FROM lineitem)"""


def _roads(spark, sf_dir):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kinds = F.array(*(F.lit(x) for x in ("motorway", "footway", "residential", None, "trunk", "path")))
    return G.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), n.alias("n"), F.when(n % 3 == 0, "road").when(n % 3 == 1, "rail").alias("subtype"), F.get(kinds, (p % 6).cast("int")).alias("class")
    )


@query("f24_road_subtype", f"WITH {_ROADS} SELECT id, n, class FROM r WHERE (subtype IS NULL OR subtype = 'road') AND (class IS NULL OR class NOT IN ({', '.join(map(repr, R.EXCLUDED['walk']))}))")
def f24_road_subtype(spark, sf_dir):
    return R.allowed(_roads(spark, sf_dir), "walk").select("id", "n", "class")


@query("f25_mode_exclusion", f"WITH {_ROADS} SELECT id, n, class FROM r WHERE class IS NULL OR class NOT IN ({', '.join(map(repr, R.EXCLUDED['drive']))})")
def f25_mode_exclusion(spark, sf_dir):
    return R.allowed(_roads(spark, sf_dir).drop("subtype"), "drive").select("id", "n", "class")


@query("f16_confidence", f"WITH {PLACES_SQL} SELECT id FROM places WHERE confidence >= 45e-2")
def f16_confidence(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.confident(0.45)).select("id")


@query("f18_presence_any", f"WITH {PLACES_SQL} SELECT id FROM places WHERE NOT coalesce(len(phones) > 0, false)")
def f18_presence_any(spark, sf_dir):
    return G.places(spark, sf_dir).filter(P.presence(F.col("websites"), None) & P.presence(F.col("phones"), False)).select("id")


@query("f26_id_in_box", f"WITH {PLACES_SQL} SELECT id, name FROM places WHERE id IN (3, 5, 8, 13, 21, 34) AND lon BETWEEN -740e-1 AND -738e-1 AND lat BETWEEN 405e-1 AND 409e-1")
def f26_id_in_box(spark, sf_dir):
    """Ids within a box, which bounds the search and is no mere preference."""
    box = (-74.0, 40.5, -73.8, 40.9)
    return G.places(spark, sf_dir).filter(geo.point_in_box(F.col("lat"), F.col("lon"), box) & F.col("id").isin(3, 5, 8, 13, 21, 34)).select("id", "name")


_POINTS = "p AS (SELECT c_custkey AS id, c_acctbal / 50e0 AS lat, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 25e0 END AS lon FROM customer)"


@query("f28_valid_points", f"WITH {_POINTS} SELECT id, coalesce(abs(lat) <= 90 AND abs(lon) <= 180, false) AS valid FROM p")
def f28_valid_points(spark, sf_dir):
    k = F.col("c_custkey")
    lat, lon = F.col("c_acctbal") / 50, F.when(k % 5 != 0, F.col("c_acctbal") / 25)
    return G.table(spark, sf_dir, "customer").select(k.alias("id"), geo.valid_point(lat, lon).alias("valid"))


@query(
    "f06_padded_prefilter",
    f"WITH {LAYER_SQL} SELECT id FROM layer WHERE lon BETWEEN -739e-1 - 5000e0 * 1002e-3 / (111320e0 * cos(radians(407e-1))) AND -739e-1 + 5000e0 * 1002e-3 / (111320e0 * cos(radians(407e-1))) AND lat BETWEEN 407e-1 - 5000e0 * 1002e-3 / 111320e0 AND 407e-1 + 5000e0 * 1002e-3 / 111320e0",
)
def f06_padded_prefilter(spark, sf_dir):
    box = geo.radius_box(LAT, LON, 5000.0 * geo.CLOSEST_POINT_PADDING)
    return G.layer(spark, sf_dir).filter(geo.point_in_box(F.col("lat"), F.col("lon"), box)).select("id")


@query("f07_clamped_radius", f"WITH {LAYER_SQL} SELECT id, least(500000e0, greatest(0e0, (id - 50) * 20000e0)) AS radius FROM layer")
def f07_clamped_radius(spark, sf_dir):
    return G.layer(spark, sf_dir).select("id", geo.clamped((F.col("id") - 50) * F.lit(20000.0)).alias("radius"))


# --- ranking and sets ------------------------------------------------------------------------------


@query(
    "l04_planar_proximity",
    f"""WITH {PLACES_SQL}, o AS (SELECT id, name FROM places ORDER BY pow(lat - 407e-1, 2) + pow((lon - -739e-1) * cos(radians(407e-1)), 2), name, id LIMIT 100)
    SELECT id, name, (SELECT count(*) FROM places) > 100 AS capped FROM o""",
)
def l04_planar_proximity(spark, sf_dir):
    rows, more = P.planar_nearest(G.places(spark, sf_dir).select("id", "name", "lat", "lon"), LAT, LON, 100)
    return rows.select("id", "name").crossJoin(F.broadcast(more))


@query("l05_id_prefix", f"WITH {PLACES_SQL} SELECT id, name FROM places ORDER BY id LIMIT 50")
def l05_id_prefix(spark, sf_dir):
    return C.sample_by_id(G.places(spark, sf_dir).select("id", "name"), 50)


@query("l08_one_row_more", f"WITH {LAYER_SQL}, o AS (SELECT id FROM layer ORDER BY id DESC LIMIT 7) SELECT id, (SELECT count(*) FROM layer) > 7 AS truncated FROM o")
def l08_one_row_more(spark, sf_dir):
    rows, more = P.truncated(G.layer(spark, sf_dir).select("id").orderBy(F.desc("id")), 7)
    return rows.crossJoin(F.broadcast(more))


_SPELLINGS = "sp AS (SELECT c_nationkey AS id, c_mktsegment AS alt, c_custkey % 3 + 1 AS tier, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS population FROM customer)"


def _spellings(spark, sf_dir):
    k = F.col("c_custkey")
    return G.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("alt"), (k % 3 + 1).alias("tier"), F.when(k % 4 != 0, k).alias("population")
    )


@query("w01_first_by_tier", f"WITH {_SPELLINGS} SELECT id, tier, population, alt FROM sp QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, population DESC NULLS LAST, alt) = 1")
def w01_first_by_tier(spark, sf_dir):
    return P.first_by(_spellings(spark, sf_dir), ["id"], ["tier", F.col("population").desc_nulls_last(), "alt"]).select("id", "tier", "population", "alt")


@query("w02_first_spelling", f"WITH {_SPELLINGS} SELECT id, min(alt) AS alt FROM sp GROUP BY id")
def w02_first_spelling(spark, sf_dir):
    return P.first_by(_spellings(spark, sf_dir), ["id"], ["alt"]).select("id", "alt")


@query("w06_surrogate_ids", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS number FROM customer")
def w06_surrogate_ids(spark, sf_dir):
    df = G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return P.numbered(df, ["c_mktsegment", "id"]).select("id", "number")


@query("j10_index_semi_join", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5)")
def j10_index_semi_join(spark, sf_dir):
    """An index of the five largest nations, and the names of those alone."""
    c = G.table(spark, sf_dir, "customer")
    index = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(5)
    return c.join(index, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("j11_region_population", "SELECT n_nationkey AS id, count(c_custkey) AS population FROM nation n LEFT JOIN (SELECT n_regionkey AS r, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey) p ON p.r = n.n_regionkey GROUP BY 1")
def j11_region_population(spark, sf_dir):
    n, c = G.table(spark, sf_dir, "nation"), G.table(spark, sf_dir, "customer")
    people = n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("population"))
    return n.join(people, "n_regionkey", "left").select(F.col("n_nationkey").alias("id"), F.coalesce("population", F.lit(0)).alias("population"))


@query(
    "j16_batch_lookup",
    f"""WITH {LAYER_SQL}, {CELLS_SQL}, {PLACES_SQL} SELECT l.id AS id, c.name AS division, count(p.id) AS near FROM layer l LEFT JOIN cells c ON l.lon > c.xmin AND l.lon < c.xmax AND l.lat > c.ymin AND l.lat < c.ymax
    LEFT JOIN places p ON {sql_distance('l.lat', 'l.lon', 'p.lat', 'p.lon')} <= 800e0 GROUP BY 1, 2""",
)
def j16_batch_lookup(spark, sf_dir):
    """Many points at once: their division and the number of places around."""
    from terralattice.operators import divisions as D

    points = G.layer(spark, sf_dir)
    around = D.chain(D.containing(points, G.cells(spark, sf_dir))).filter("level = 1").select("id", F.col("name").alias("division"))
    near = P.pairs_within(points, G.places(spark, sf_dir), 800.0).groupBy("id").agg(F.count(F.lit(1)).alias("near"))
    return points.select("id").join(around, "id", "left").join(near, "id", "left").select("id", "division", F.coalesce("near", F.lit(0)).alias("near"))


@query("u03_union_first_wins", f"WITH {PLACES_SQL}, {LAYER_SQL}, u AS (SELECT lower(name) AS name, 1 AS pri, id FROM places UNION ALL SELECT lower(coalesce(name, 'bolt')), 2, id FROM layer) SELECT name, pri, id FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY pri, id) = 1")
def u03_union_first_wins(spark, sf_dir):
    a = G.places(spark, sf_dir).select(F.lower("name").alias("name"), F.lit(1).alias("pri"), "id")
    b = G.layer(spark, sf_dir).select(F.lower(F.coalesce("name", F.lit("bolt"))).alias("name"), F.lit(2).alias("pri"), "id")
    return P.first_by(a.unionAll(b), ["name"], ["pri", "id"])


@query("u04_except", "SELECT c_nationkey AS id FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def u04_except(spark, sf_dir):
    return G.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")).subtract(G.table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u04_except_all", "SELECT c_nationkey AS id FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u04_except_all(spark, sf_dir):
    return G.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")).exceptAll(G.table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u04_intersect", "SELECT c_nationkey AS id FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u04_intersect(spark, sf_dir):
    return G.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")).intersect(G.table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("a14_truncation_flags", f"""WITH {PLACES_SQL}, a AS (SELECT id FROM places WHERE id % 10 <> 0), b AS (SELECT id FROM places WHERE id % 10 <> 1)
    SELECT 'appeared' AS change, count(*) AS n, count(*) > 150 AS truncated FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'disappeared', count(*), count(*) > 150 FROM a WHERE id NOT IN (SELECT id FROM b)""")
def a14_truncation_flags(spark, sf_dir):
    counted = C.counts(C.diff(*G.releases(spark, sf_dir))).filter(F.col("change").isin("appeared", "disappeared"))
    return counted.withColumn("truncated", F.col("n") > 150)


@query("a21_distinct_keep_best", f"WITH {ADDRESSES_SQL} SELECT street, postcode, min(id) AS id FROM addresses GROUP BY 1, 2")
def a21_distinct_keep_best(spark, sf_dir):
    return P.first_by(G.addresses(spark, sf_dir).select("street", "postcode", "id"), ["street", "postcode"], ["id"])


@query("a07_union_extent", f"WITH {CELLS_SQL}, {LAYER_SQL} SELECT l.id AS id, c.division_id AS division_id FROM layer l JOIN cells c ON l.lon > c.xmin AND l.lon < c.xmax AND l.lat > c.ymin AND l.lat < c.ymax")
def a07_union_extent(spark, sf_dir):
    """The parts of a division as one multi-polygon, which holds a point if any part does."""
    parts = G.cells(spark, sf_dir).groupBy("division_id").agg(F.collect_list("polygon").alias("shape"))
    # A division has few parts and there are few divisions; the points meet them in one pass.
    return G.layer(spark, sf_dir).join(F.broadcast(parts), shape.contains_any(F.col("shape"), F.col("lon"), F.col("lat"))).select("id", "division_id")


@query("a11_margin", f"""WITH {PLACES_SQL}, c AS (SELECT CASE WHEN lat >= 407e-1 THEN 'north' ELSE 'south' END AS area, category AS priority, count(*) AS n FROM places GROUP BY 1, 2),
    s AS (SELECT area, 25e-2 * CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY priority) AS part FROM c), t AS (SELECT area, round(sum(part), 3) AS score FROM s GROUP BY 1)
    SELECT area, score, round(max(score) OVER () - min(score) OVER (), 3) AS margin FROM t""")
def a11_margin(spark, sf_dir):
    c = G.places(spark, sf_dir).groupBy(F.when(F.col("lat") >= 40.7, "north").otherwise("south").alias("area"), F.col("category").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    scored = A.weighted_verdict(c.withColumns({"weight": F.lit(0.25), "fewer": F.lit(False)}))
    return A.margin(scored).select("area", "score", "margin")


# --- text and nested columns -------------------------------------------------------------------------


@query("e01_like_escape", r"WITH x AS (SELECT c_custkey AS id, c_name || CASE c_custkey % 4 WHEN 0 THEN '50%_off' WHEN 1 THEN '50x_off' WHEN 2 THEN '50%xoff' ELSE 'a\b' END AS t FROM customer) SELECT id FROM x WHERE contains(lower(t), '50%_off')")
def e01_like_escape(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.concat("c_name", F.when(k % 4 == 0, "50%_off").when(k % 4 == 1, "50x_off").when(k % 4 == 2, "50%xoff").otherwise("a\\b"))
    return G.table(spark, sf_dir, "customer").select(k.alias("id"), t.alias("t")).filter(F.col("t").ilike(f"%{X.like_escape('50%_OFF')}%")).select("id")


@query("e05_window_similarity", "SELECT DISTINCT p_name AS name, round(greatest(jaro_winkler_similarity(p_name, 'smal'), jaro_winkler_similarity(left(p_name, 4), 'smal')), 6) AS similarity FROM part")
def e05_window_similarity(spark, sf_dir):
    names = G.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.round(X.window_similarity(F.col("name"), F.lit("smal")), 6).alias("similarity"))


@query("e06_match_tier", f"WITH {PLACES_SQL} SELECT id, CASE WHEN name = 'small ring' THEN 3 WHEN starts_with(name, 'small') THEN CASE WHEN contains('small ring', name) THEN 0 ELSE 0 END ELSE 0 END AS whole, CASE WHEN name = 'small' THEN 3 WHEN starts_with(name, 'small') THEN 2 WHEN contains(name, 'small') THEN 1 ELSE 0 END AS part FROM places")
def e06_match_tier(spark, sf_dir):
    return G.places(spark, sf_dir).select("id", X.match_tier(F.col("name"), F.lit("Small Ring")).alias("whole"), X.match_tier(F.col("name"), F.lit("SMALL")).alias("part"))


def _nested(spark, sf_dir):
    """Places in the shape that releases have: names, brand, taxonomy and lists of structs."""
    k = F.col("id")
    return G.places(spark, sf_dir).select(
        k.cast("string").alias("id"),
        F.struct(F.col("name").alias("primary")).alias("names"),
        F.when(F.col("brand").isNotNull(), F.struct(F.struct(F.col("brand").alias("primary")).alias("names"))).alias("brand"),
        F.when(k % 6 != 5, F.struct(F.lower("category").alias("primary"), F.col("alternates"))).alias("taxonomy"),
        F.array(F.struct(F.concat(F.lit("L"), (k % 9).cast("string")).alias("value")), F.struct(F.concat(F.lit("M"), (k % 4).cast("string")).alias("value"))).alias("levels"),
        F.array(F.array(F.struct(F.concat(F.lit("H"), (k % 5).cast("string")).alias("name"), k.alias("n")))).alias("hierarchies"),
        F.col("confidence"),
        F.col("phones"),
    )


@query("e40_struct_access", f"WITH {PLACES_SQL} SELECT CAST(id AS VARCHAR) AS id, name, brand, CASE WHEN id % 6 <> 5 THEN lower(category) END AS category FROM places")
def e40_struct_access(spark, sf_dir):
    return _nested(spark, sf_dir).select("id", F.col("names.primary").alias("name"), F.col("brand.names.primary").alias("brand"), F.col("taxonomy.primary").alias("category"))


@query("e42_list_of_fields", f"WITH {PLACES_SQL} SELECT CAST(id AS VARCHAR) AS id, 'L' || (id % 9) || ',M' || (id % 4) AS levels FROM places")
def e42_list_of_fields(spark, sf_dir):
    return _nested(spark, sf_dir).select("id", F.array_join(F.transform("levels", lambda x: x["value"]), ",").alias("levels"))


@query("e44_nested_index", f"WITH {PLACES_SQL} SELECT CAST(id AS VARCHAR) AS id, 'H' || (id % 5) AS top, CAST(NULL AS VARCHAR) AS beyond FROM places")
def e44_nested_index(spark, sf_dir):
    first = F.get(F.get("hierarchies", F.lit(0)), F.lit(0))
    return _nested(spark, sf_dir).select("id", first["name"].alias("top"), F.get(F.get("hierarchies", F.lit(0)), F.lit(7))["name"].alias("beyond"))


@query("e45_struct_in_case", f"WITH {PLACES_SQL} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 6 <> 5 THEN lower(category) ELSE 'other' END AS leaf, CASE WHEN id % 6 <> 5 THEN 'known' ELSE 'unknown' END AS root FROM places")
def e45_struct_in_case(spark, sf_dir):
    path = F.when(F.col("taxonomy").isNotNull(), F.struct(F.lit("known").alias("root"), F.col("taxonomy.primary").alias("leaf"))).otherwise(
        F.struct(F.lit("unknown").alias("root"), F.lit("other").alias("leaf"))
    )
    return _nested(spark, sf_dir).select("id", path["leaf"].alias("leaf"), path["root"].alias("root"))


@query("e47_rows_without_nulls", f"""WITH {PLACES_SQL} SELECT id, CASE WHEN brand IS NULL THEN 2 ELSE 3 END + CASE WHEN coalesce(len(phones), 0) > 0 THEN 1 ELSE 0 END AS fields FROM places""")
def e47_rows_without_nulls(spark, sf_dir):
    from terralattice.operators import answers as W

    rows = G.places(spark, sf_dir).select("id", "name", "brand", "phones")
    text = W.compact_json(rows.columns, rows)
    return rows.select("id", F.size(F.json_object_keys(text)).alias("fields"))


@query("e48_json_tokens", f"""WITH {PLACES_SQL} SELECT id, length('{{"id": ' || id || ', "name": "' || name || '"' || CASE WHEN brand IS NULL THEN '' ELSE ', "brand": "' || brand || '"' END || '}}') // 4 AS tokens FROM places""")
def e48_json_tokens(spark, sf_dir):
    from terralattice.operators import answers as W

    rows = G.places(spark, sf_dir).select("id", "name", "brand")
    return rows.select("id", F.floor(W.json_length(["id", "name", "brand"]) / 4).alias("tokens"))


@query("e25_posted_limits", """WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, [l_quantity * CASE WHEN l_returnflag = 'A' THEN 44704e-5 ELSE 1e0 / 36e-1 END, CASE WHEN l_linenumber % 2 = 0 THEN 5e0 / 36e-1 END,
      CASE WHEN l_linenumber % 3 = 0 THEN 30e0 / 36e-1 END] AS limits FROM lineitem) SELECT id, n, round(list_min(limits), 6) AS mps FROM s""")
def e25_posted_limits(spark, sf_dir):
    """The slowest limit of a whole segment; one for a part of it does not count."""
    n = F.col("l_linenumber")
    limit = lambda value, unit, between: F.struct(F.struct(value.cast("double").alias("value"), unit.alias("unit")).alias("max_speed"), between.cast("array<double>").alias("between"))
    limits = F.array(
        limit(F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", "mph"), F.lit(None)),
        limit(F.when(n % 2 == 0, F.lit(5.0)), F.lit("km/h"), F.array()),
        limit(F.when(n % 3 == 0, F.lit(30.0)), F.lit("kmh"), F.lit(None)),
        limit(F.lit(0.5), F.lit("km/h"), F.array(F.lit(0.1), F.lit(0.4))),
    )
    return G.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), F.round(R.posted_limit(limits), 6).alias("mps"))


@query("n02_one_ways", """SELECT l_orderkey AS id, l_linenumber AS n, NOT (l_linenumber % 4 = 1 OR l_linenumber % 4 = 3) AS forward, NOT (l_linenumber % 4 = 2 OR l_linenumber % 4 = 3) AS backward FROM lineitem""")
def n02_one_ways(spark, sf_dir):
    """Denied access by heading and mode: one for bicycles does not stop a car."""
    n = F.col("l_linenumber")
    denied = lambda kind, heading, modes: F.struct(kind.alias("access_type"), F.struct(heading.cast("string").alias("heading"), modes.cast("array<string>").alias("mode")).alias("when"))
    rules = F.array(
        denied(F.when(n % 4 > 0, "denied").otherwise("allowed"), F.when(n % 4 == 1, "forward").when(n % 4 == 2, "backward"), F.when(n % 2 == 0, F.array(F.lit("car")))),
        denied(F.lit("denied"), F.lit("forward"), F.array(F.lit("bicycle"))),
    )
    forward, backward = R.directions(rules, "drive")
    return G.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), forward.alias("forward"), backward.alias("backward"))


# --- geometry ------------------------------------------------------------------------------------------


@query("g12_nearest_of_set", f"WITH {LAYER_SQL}, s AS (SELECT * FROM (VALUES (1, 4055e-2, -7405e-2), (2, 407e-1, -739e-1), (3, 4085e-2, -7375e-2)) v(i, a, b)) SELECT id, arg_min(i, {{'d': {sql_distance('lat', 'lon', 'a', 'b')}, 'i': i}}) AS nearest FROM layer, s GROUP BY id")
def g12_nearest_of_set(spark, sf_dir):
    some = F.array(*(shape.vertex(F.lit(x), F.lit(y)) for y, x in ((40.55, -74.05), (40.7, -73.9), (40.85, -73.75))))
    return G.layer(spark, sf_dir).select("id", (shape.nearest_of(some, F.col("lat"), F.col("lon")) + 1).alias("nearest"))


_BEND = f"o AS (SELECT o_orderkey AS id, {sql_lat('o_orderkey')} AS lat, {sql_lon('o_orderkey')} AS lon, CAST(o_orderkey % 7 - 3 AS DOUBLE) * 1e-3 AS bend FROM orders)"


@query(
    "g15_point_along",
    f"""WITH {_BEND}, m AS (SELECT *, {sql_distance('lat', 'lon', 'lat + bend', 'lon + 4e-3')} AS a, {sql_distance('lat + bend', 'lon + 4e-3', 'lat', 'lon + 8e-3')} AS b FROM o),
    t AS (SELECT *, CAST(id % 10 AS DOUBLE) / 10e0 * (a + b) AS d FROM m)
    SELECT id, round(CASE WHEN d <= a THEN lat + bend * d / a ELSE lat + bend - bend * (d - a) / b END, 7) AS y, round(CASE WHEN d <= a THEN lon + 4e-3 * d / a ELSE lon + 4e-3 + 4e-3 * (d - a) / b END, 7) AS x FROM t""",
)
def g15_point_along(spark, sf_dir):
    share = (F.col("id") % 10).cast("double") / F.lit(10.0)
    p = shape.point_along(F.col("line"), share)
    return G.waterways(spark, sf_dir).select("id", F.round(p["y"], 7).alias("y"), F.round(p["x"], 7).alias("x"))


@query(
    "g13_fraction_on_line",
    f"""WITH {_BEND}, s AS (SELECT id, cos(radians(407e-1)) AS s, lon, lat, bend FROM o),
    p AS (SELECT id, lon AS ax, lat AS ay, lon + 4e-3 AS bx, lat + bend AS by_, 0 AS leg, s FROM s UNION ALL SELECT id, lon + 4e-3, lat + bend, lon + 8e-3, lat, 1, s FROM s),
    t AS (SELECT *, least(1e0, greatest(0e0, ((-739e-1 - ax) * s * (bx - ax) * s + (407e-1 - ay) * (by_ - ay)) / (pow((bx - ax) * s, 2) + pow(by_ - ay, 2)))) AS t FROM p),
    d AS (SELECT id, leg, t, pow((-739e-1 - ax - t * (bx - ax)) * s, 2) + pow(407e-1 - ay - t * (by_ - ay), 2) AS d2, {sql_distance('ay', 'ax', 'by_', 'bx')} AS m FROM t),
    l AS (SELECT id, max(m) FILTER (WHERE leg = 0) AS a, max(m) FILTER (WHERE leg = 1) AS b, arg_min(leg, {{'d': d2, 'l': leg}}) AS leg, arg_min(t, {{'d': d2, 'l': leg}}) AS t FROM d GROUP BY id)
    SELECT id, round((CASE WHEN leg = 0 THEN t * a ELSE a + t * b END) / (a + b), 4) AS fraction FROM l""",
)
def g13_fraction_on_line(spark, sf_dir):
    return G.waterways(spark, sf_dir).select("id", F.round(shape.fraction_on(F.col("line"), F.lit(LAT), F.lit(LON)), 4).alias("fraction"))


@query("g06_dimension_extent", f"WITH {_BEND} SELECT id, 1 AS dimension, round(greatest(8e-3, abs(bend)), 6) AS span FROM o")
def g06_dimension_extent(spark, sf_dir):
    return G.waterways(spark, sf_dir).select("id", shape.dimension(F.lit("line")).alias("dimension"), F.round(shape.span(F.col("line")), 6).alias("span"))


@query("g03_centroid_with_hole", f"""WITH {CELLS_SQL} SELECT id, round(((xmin + xmax) / 2e0 * 64e-4 - (xmin + 1e-2) * 4e-4) / 60e-4, 7) AS x, round(((ymin + ymax) / 2e0 * 64e-4 - (ymin + 1e-2) * 4e-4) / 60e-4, 7) AS y, round(60e-4, 7) AS area FROM cells""")
def g03_centroid_with_hole(spark, sf_dir):
    """Cells of 0.08 degrees with a square hole of 0.02 in one corner."""
    x, y = F.col("xmin"), F.col("ymin")
    hole = shape.rectangle(x, y, x + 0.02, y + 0.02)
    df = G.cells(spark, sf_dir).withColumn("holed", F.array(F.get("polygon", F.lit(0)), hole))
    c = shape.centroid(F.col("holed"))
    return df.select("id", F.round(c["x"], 7).alias("x"), F.round(c["y"], 7).alias("y"), F.round(shape.area(F.col("holed")), 7).alias("area"))


@query("e21_grid_metres", f"WITH {LAYER_SQL} SELECT id, round((lon - -739e-1) * 111320e0 * cos(radians(407e-1)), 2) AS x, round((lat - 407e-1) * 110540e0, 2) AS y FROM layer")
def e21_grid_metres(spark, sf_dir):
    x, y = geo.grid_metres(F.col("lat"), F.col("lon"), LAT, LON)
    return G.layer(spark, sf_dir).select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("g16_enclosing_circle", f"""WITH {LAYER_SQL}, s AS (SELECT id % 20 AS g, round((lon + 741e-1) * 25000e0) AS x, round((lat - 405e-1) * 25000e0) AS y FROM layer),
    p AS (SELECT DISTINCT g, x, y FROM s), pair AS (SELECT a.g AS g, (a.x + b.x) / 2e0 AS x, (a.y + b.y) / 2e0 AS y, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2e0 AS r FROM p a JOIN p b ON a.g = b.g AND (a.x, a.y) < (b.x, b.y)),
    d AS (SELECT a.g AS g, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, 2e0 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d FROM p a JOIN p b ON a.g = b.g AND (a.x, a.y) < (b.x, b.y) JOIN p c ON c.g = b.g AND (b.x, b.y) < (c.x, c.y)),
    u AS (SELECT g, ax, ay, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d AS x, ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d AS y FROM d WHERE d <> 0),
    c AS (SELECT * FROM pair UNION ALL SELECT g, x, y, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) FROM u UNION ALL SELECT g, x, y, 0e0 FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) = 1))
    SELECT g, round(min(r), 4) AS radius FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = c.g AND sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)) > c.r * (1e0 + 1e-9) + 1e-9) GROUP BY g""")
def g16_enclosing_circle(spark, sf_dir):
    x, y = F.round((F.col("lon") + 74.1) * 25000), F.round((F.col("lat") - 40.5) * 25000)
    points = G.layer(spark, sf_dir).select((F.col("id") % 20).alias("g"), x.alias("x"), y.alias("y"))
    return shape.circles(points, "g", "x", "y").select("g", F.round("circle.r", 4).alias("radius"))
