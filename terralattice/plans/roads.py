"""Queries on the road graph, routes, corridors, meetings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from terralattice.functions import shape
from terralattice.functions.geo import haversine
from terralattice.operators import graph as R
from terralattice.plans import geography as G
from terralattice.plans._register import LAYER_SQL, PLACES_SQL, query, sql_distance, sql_lat, sql_lon

_EDGES = """edges AS (
  SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
    l_quantity AS metres, l_returnflag AS class, l_linestatus = 'F' AS oneway FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
_SPEED = {"A": 10.0, "N": 5.0}
_COSTS = f"""{_EDGES}, there AS (SELECT src, dst, metres / CASE class WHEN 'A' THEN 10e0 WHEN 'N' THEN 5e0 ELSE 8e0 END AS seconds, oneway FROM edges),
directed AS (SELECT src, dst, min(seconds) AS seconds FROM (SELECT src, dst, seconds FROM there UNION ALL SELECT dst, src, seconds FROM there WHERE NOT oneway) GROUP BY 1, 2)"""


_STREETS = f"""s AS (SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS node, CASE WHEN count(*) OVER w = 1 THEN 5e-1 ELSE CAST(row_number() OVER o - 1 AS DOUBLE) / (count(*) OVER w - 1) END AS pos,
    {sql_lat('l_orderkey')} AS lat, {sql_lon('l_orderkey')} AS lon FROM lineitem WINDOW w AS (PARTITION BY l_orderkey), o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
  stops AS (SELECT id, node, pos, lat, lon FROM s UNION ALL SELECT id, 'pt_' || CAST(round(lon, 6) AS VARCHAR) || '_' || CAST(round(lat, 6) AS VARCHAR), 0e0, lat, lon FROM s WHERE pos = 5e-1 AND id IN (SELECT id FROM s GROUP BY id HAVING count(*) = 1)
    UNION ALL SELECT id, 'pt_' || CAST(round(lon + 1e-2, 6) AS VARCHAR) || '_' || CAST(round(lat + 5e-3, 6) AS VARCHAR), 1e0, lat, lon FROM s WHERE pos = 5e-1 AND id IN (SELECT id FROM s GROUP BY id HAVING count(*) = 1))"""


@query(
    "n01_graph_edges",
    f"""WITH {_STREETS}, e AS (SELECT id, node AS src, lead(node) OVER w AS dst, lead(pos) OVER w - pos AS share, {sql_distance('lat', 'lon', 'lat + 5e-3', 'lon + 1e-2')} AS m FROM stops WINDOW w AS (PARTITION BY id ORDER BY pos, node))
    SELECT id, src, dst, round(share * m, 3) AS metres FROM e WHERE dst IS NOT NULL AND src <> dst""",
)
def n01_graph_edges(spark, sf_dir):
    """Streets cut at their connectors; ends without one get an id from where they lie."""
    return R.from_segments(G.segments(spark, sf_dir)).select("id", "src", "dst", F.round("metres", 3).alias("metres"))


@query("n02_edge_costs", f"WITH {_COSTS} SELECT src, dst, round(seconds, 6) AS seconds FROM directed")
def n02_edge_costs(spark, sf_dir):
    return R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED).select("src", "dst", F.round("seconds", 6).alias("seconds"))


def _reach_sql(seconds, start="SELECT CAST(7 AS BIGINT) AS origin, CAST(7 AS BIGINT) AS node"):
    """r: the least seconds from each origin to each node within a budget, relaxed until none gets cheaper."""
    within = "" if seconds is None else f" AND r.seconds + d.seconds <= {seconds}"
    return f"""r(origin, node, seconds) USING KEY (origin, node) AS (SELECT origin, node, 0e0 FROM ({start}) UNION
      SELECT r.origin, d.dst, min(r.seconds + d.seconds) FROM r JOIN directed d ON d.src = r.node LEFT JOIN recurring.r b ON b.origin = r.origin AND b.node = d.dst
      WHERE (b.seconds IS NULL OR r.seconds + d.seconds < b.seconds){within} GROUP BY r.origin, d.dst)"""


@query("n05_reachable_within", f"WITH RECURSIVE {_COSTS}, {_reach_sql('6e0')} SELECT origin, node, round(seconds, 6) AS seconds FROM r")
def n05_reachable_within(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    start = spark.range(7, 8).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    found = R.reachable(directed, start, 6.0)
    return found.select("origin", "node", F.round("seconds", 6).alias("seconds"))


@query(
    "n07_one_to_many",
    f"""WITH RECURSIVE {_COSTS}, {_reach_sql(None, "SELECT i AS origin, i AS node FROM range(3) t(i)")}
    SELECT o.i AS origin, d.i AS destination, round(r.seconds, 6) AS seconds FROM range(3) o(i) CROSS JOIN range(10, 15) d(i) LEFT JOIN r ON r.origin = o.i AND r.node = d.i""",
)
def n07_one_to_many(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    pairs = spark.range(3).select(F.col("id").alias("origin")).crossJoin(spark.range(10, 15).select(F.col("id").alias("destination")))
    return R.one_to_many(directed, pairs).select("origin", "destination", F.round("seconds", 6).alias("seconds"))


_TREE = """tree AS (SELECT r.origin AS origin, d.dst AS node, min(d.src) AS before FROM r JOIN directed d ON d.src = r.node JOIN r b ON b.origin = r.origin AND b.node = d.dst
  WHERE b.seconds > 0e0 AND r.seconds + d.seconds = b.seconds GROUP BY 1, 2)"""


@query(
    "n06_fastest_paths",
    f"""WITH RECURSIVE {_COSTS}, {_reach_sql(None)}, {_TREE},
    p(destination, node, i) AS (SELECT i, i, 0 FROM range(10, 20) t(i) UNION ALL SELECT p.destination, tree.before, p.i + 1 FROM p JOIN tree ON tree.node = p.node)
    SELECT destination, string_agg(CAST(node AS VARCHAR), '>' ORDER BY i DESC) AS path FROM p WHERE destination IN (SELECT node FROM r) GROUP BY destination""",
)
def n06_fastest_paths(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    pairs = spark.range(10, 20).select(F.lit(7).cast("long").alias("origin"), F.col("id").alias("destination"))
    steps = R.fastest_paths(directed, pairs)
    way = F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda s: s["node"].cast("string"))
    return steps.groupBy("destination").agg(F.array_join(way, ">").alias("path"))


_WALKS = f"""{_EDGES}, directed AS (SELECT src, dst, min(metres / 14e-1) AS seconds FROM (SELECT src, dst, metres FROM edges UNION ALL SELECT dst, src, metres FROM edges) GROUP BY 1, 2)"""


@query(
    "n12_travel_time_matrix",
    f"""WITH RECURSIVE {_WALKS}, {_reach_sql(None, "SELECT i AS origin, i AS node FROM range(5) t(i)")}
    SELECT o.i AS origin, d.i AS destination, round(r.seconds / 60e0, 2) AS minutes FROM range(5) o(i) CROSS JOIN range(5) d(i) LEFT JOIN r ON r.origin = o.i AND r.node = d.i""",
)
def n12_travel_time_matrix(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "walk")
    stops = spark.range(5).select("id")
    pairs = stops.select(F.col("id").alias("origin")).crossJoin(stops.select(F.col("id").alias("destination")))
    return R.one_to_many(directed, pairs).select("origin", "destination", F.round(F.col("seconds") / 60, 2).alias("minutes"))


_COMPONENTS = f"""{_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
c(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM b UNION
  SELECT b.dst, min(c.component) FROM c JOIN b ON b.src = c.node JOIN recurring.c o ON o.node = b.dst WHERE c.component < o.component GROUP BY b.dst)"""


@query("n04_components", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM c")
def n04_components(spark, sf_dir):
    return R.components(G.road_edges(spark, sf_dir).select("src", "dst"))


def _nodes(spark, sf_dir):
    """node, component, size, lat, lon of every node of the road graph."""
    found = R.components(G.road_edges(spark, sf_dir).select("src", "dst"))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "component").select("node", "component", "size", G.key_lat(F.col("node")).alias("lat"), G.key_lon(F.col("node")).alias("lon"))


@query(
    "n03_snap",
    f"""WITH RECURSIVE {_COMPONENTS}, {LAYER_SQL}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1),
    n AS (SELECT node, size, c.component = (SELECT arg_min(component, {{'a': -size, 'b': component}}) FROM z) AS main, {sql_lat('node')} AS lat, {sql_lon('node')} AS lon FROM c JOIN z USING (component)),
    d AS (SELECT l.id AS id, n.node AS node, size, main, {sql_distance('l.lat', 'l.lon', 'n.lat', 'n.lon')} AS m FROM layer l, n)
    SELECT id, node, round(m, 1) AS distance FROM d WHERE (m <= 300e0 AND (size >= 5 OR main)) OR (m > 300e0 AND m <= 1200e0 AND size >= 5)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY m > 300e0, m, node) = 1""",
)
def n03_snap(spark, sf_dir):
    return R.snap(G.layer(spark, sf_dir), _nodes(spark, sf_dir)).select("id", "node", F.round("distance", 1).alias("distance"))


_REACH = f"""{_COSTS}, {_reach_sql('5e0')},
cells AS (SELECT DISTINCT CAST(floor({sql_lon('node')} * (111320e0 / 2000e0)) AS BIGINT) AS gx, CAST(floor({sql_lat('node')} * (111320e0 / 2000e0)) AS BIGINT) AS gy FROM r)"""


def _reached(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    start = spark.range(7, 8).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return R.reachable(directed, start, 5.0).select(G.key_lat(F.col("node")).alias("lat"), G.key_lon(F.col("node")).alias("lon"))


@query("n08_isochrone_cells", f"WITH RECURSIVE {_REACH} SELECT gx, gy FROM cells")
def n08_isochrone_cells(spark, sf_dir):
    return R.boundary_edges(_reached(spark, sf_dir), 2000.0)[0]


@query(
    "g18_boundary_edges",
    f"""WITH RECURSIVE {_REACH}, s AS (SELECT * FROM (VALUES ('e', 1, 0), ('n', 0, 1), ('s', 0, -1), ('w', -1, 0)) t(side, dx, dy))
    SELECT c.gx AS gx, c.gy AS gy, side FROM cells c, s WHERE NOT EXISTS (SELECT 1 FROM cells d WHERE d.gx = c.gx + dx AND d.gy = c.gy + dy)""",
)
def g18_boundary_edges(spark, sf_dir):
    return R.boundary_edges(_reached(spark, sf_dir), 2000.0)[1]


_D = sql_distance("a.lat", "a.lon", "b.lat", "b.lon")


@query(
    "n10_tour_exact",
    f"""WITH {LAYER_SQL}, s AS (SELECT id, lat, lon FROM layer WHERE id < 6), d AS (SELECT a.id AS i, b.id AS j, {_D} AS m FROM s a, s b),
    t AS (SELECT p.id AS a, q.id AS b, r.id AS c, u.id AS e, v.id AS f FROM s p, s q, s r, s u, s v
      WHERE p.id > 0 AND q.id > 0 AND r.id > 0 AND u.id > 0 AND v.id > 0 AND len(list_distinct([p.id, q.id, r.id, u.id, v.id])) = 5),
    c AS (SELECT '0,' || a || ',' || b || ',' || c || ',' || e || ',' || f AS tour, d1.m + d2.m + d3.m + d4.m + d5.m + d6.m AS metres FROM t
      JOIN d d1 ON d1.i = 0 AND d1.j = a JOIN d d2 ON d2.i = a AND d2.j = b JOIN d d3 ON d3.i = b AND d3.j = c
      JOIN d d4 ON d4.i = c AND d4.j = e JOIN d d5 ON d5.i = e AND d5.j = f JOIN d d6 ON d6.i = f AND d6.j = 0)
    SELECT tour, round(metres, 1) AS metres FROM c WHERE metres <= (SELECT min(metres) FROM c) + 1e-6 ORDER BY tour LIMIT 1""",
)
def n10_tour_exact(spark, sf_dir):
    stops = G.layer(spark, sf_dir).filter("id < 6").select(F.lit(1).alias("trip"), "id", "lat", "lon")
    a, b = stops.alias("a"), stops.alias("b")
    legs = a.join(b, F.col("a.trip") == F.col("b.trip")).select(
        F.col("a.trip").alias("trip"), F.col("a.id").alias("i"), F.col("b.id").alias("j"),
        haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("m"),
    )

    def tour(group: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(group["i"]))
        metres = {(i, j): m for i, j, m in zip(group["i"], group["j"], group["m"])}
        total, order = R.best_tour([[metres[i, j] for j in ids] for i in ids], round_trip=True)
        return pd.DataFrame({"tour": [",".join(str(ids[k]) for k in order)], "metres": [total]})

    return legs.groupBy("trip").applyInPandas(tour, "tour string, metres double").select("tour", F.round("metres", 1).alias("metres"))


@query(
    "n11_estimated_legs",
    f"""WITH {LAYER_SQL} SELECT a.id AS i, b.id AS j, round(14e-1 * {_D}, 0) AS metres, true AS estimated FROM layer a, layer b WHERE a.id < 5 AND b.id < 5 AND a.id <> b.id""",
)
def n11_estimated_legs(spark, sf_dir):
    a = G.layer(spark, sf_dir).filter("id < 5")
    b = a.select(F.col("id").alias("j"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    legs = F.broadcast(a).crossJoin(b).filter("id <> j")
    return legs.select(F.col("id").alias("i"), "j", F.round(R.DETOUR * haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")), 0).alias("metres"), F.lit(True).alias("estimated"))


_LINE = [(-74.0, 40.6), (-73.95, 40.68), (-73.85, 40.7)]


def _leg_sql(ax, ay, bx, by, before):
    """offset and place along the route of the nearest point on one leg, and the leg's length."""
    scale = "greatest(cos(radians(lat)), 1e-9)"
    square = f"(pow(({bx} - {ax}) * {scale}, 2) + pow({by} - {ay}, 2))"
    t = f"least(1e0, greatest(0e0, ((lon - {ax}) * {scale} * ({bx} - {ax}) * {scale} + (lat - {ay}) * ({by} - {ay})) / {square}))"
    py, px = f"({ay} + {t} * ({by} - {ay}))", f"({ax} + {t} * ({bx} - {ax}))"
    return f"SELECT id, {sql_distance('lat', 'lon', py, px)} AS off, {before} + {t} * {sql_distance(ay, ax, by, bx)} AS along FROM places"


_LEGS = [("-740e-1", "406e-1", "-7395e-2", "4068e-2"), ("-7395e-2", "4068e-2", "-7385e-2", "407e-1")]
_CORRIDOR = f"""WITH {PLACES_SQL}, l AS ({_leg_sql(*_LEGS[0], '0e0')} UNION ALL {_leg_sql(*_LEGS[1], sql_distance('406e-1', '-740e-1', '4068e-2', '-7395e-2'))}),
c AS (SELECT id, min({{'off': off, 'along': along}}) AS b FROM l WHERE off <= 1500e0 GROUP BY id)"""


@query("j15_corridor_places", f"{_CORRIDOR} SELECT id, round(b.off, 1) AS \"offset\", round(b.along, 0) AS along, round(2e0 * b.off, 1) AS detour FROM c")
def j15_corridor_places(spark, sf_dir):
    line = F.array(*(shape.vertex(F.lit(x), F.lit(y)) for x, y in _LINE))
    found = R.corridor(G.places(spark, sf_dir), line, 1500.0)
    return found.select("id", F.round("offset", 1).alias("offset"), F.round("along", 0).alias("along"), F.round("detour", 1).alias("detour"))


@query(
    "n13_places_along_route",
    f"""{_CORRIDOR}, r AS (SELECT id, row_number() OVER (ORDER BY b.along, b.off, id) - 1 AS i, count(*) OVER () AS n FROM c)
    SELECT id, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS stop FROM r WHERE n <= 8 OR i IN (SELECT CAST(floor(j * (n - 1) / 7e0 + 5e-1) AS BIGINT) FROM (SELECT unnest(generate_series(0, 7)) AS j))""",
)
def n13_places_along_route(spark, sf_dir):
    line = F.array(*(shape.vertex(F.lit(x), F.lit(y)) for x, y in _LINE))
    found = R.corridor(G.places(spark, sf_dir), line, 1500.0, k=8)
    return found.select("id", F.row_number().over(Window.orderBy("along", "detour", "id")).alias("stop"))


@query(
    "w09_even_sample",
    f"""WITH {PLACES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM places WHERE category = 'LARGE')
    SELECT id FROM r WHERE i IN (SELECT CAST(floor(j * (n - 1) / 9e0 + 5e-1) AS BIGINT) FROM (SELECT unnest(generate_series(0, 9)) AS j))""",
)
def w09_even_sample(spark, sf_dir):
    return R.even_sample(G.places(spark, sf_dir).filter("category = 'LARGE'").select("id"), 10, ["id"])


@query(
    "n14_meeting_rank",
    f"""WITH {LAYER_SQL}, o AS (SELECT * FROM (VALUES (1, 406e-1, -740e-1), (2, 407e-1, -739e-1), (3, 408e-1, -738e-1)) t(origin, olat, olon)),
    l AS (SELECT id AS place, origin, {sql_distance('lat', 'lon', 'olat', 'olon')} / 14e-1 AS s FROM layer, o),
    p AS (SELECT place, max(s) AS worst, max(s) - min(s) AS spread, sum(s) AS total FROM l GROUP BY place)
    SELECT place, round(worst, 0) AS worst, CAST(row_number() OVER (ORDER BY worst, spread, total, place) AS INTEGER) AS rank FROM p""",
)
def n14_meeting_rank(spark, sf_dir):
    origins = spark.createDataFrame([(1, 40.6, -74.0), (2, 40.7, -73.9), (3, 40.8, -73.8)], "origin int, olat double, olon double")
    legs = G.layer(spark, sf_dir).crossJoin(F.broadcast(origins)).select(
        F.col("id").alias("place"), "origin", (haversine(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) / R.WALK).alias("seconds")
    )
    return R.meeting_rank(legs).select("place", F.round("worst", 0).alias("worst"), "rank")


@query(
    "e25_speed_limits",
    "SELECT l_orderkey AS id, l_linenumber AS n, round(l_quantity * CASE WHEN l_returnflag = 'A' THEN 44704e-5 ELSE 1e0 / 36e-1 END, 6) AS mps FROM lineitem",
)
def e25_speed_limits(spark, sf_dir):
    unit = F.when(F.col("l_returnflag") == "A", "mph").otherwise("km/h")
    return G.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.round(R.speed_limit(F.col("l_quantity"), unit), 6).alias("mps")
    )


@query(
    "w10_polyline_arc_length",
    f"""WITH o AS (SELECT o_orderkey AS id, {sql_lat('o_orderkey')} AS lat, {sql_lon('o_orderkey')} AS lon, CAST(o_orderkey % 7 - 3 AS DOUBLE) * 1e-3 AS bend FROM orders),
    v AS (SELECT id, 1 AS i, {sql_distance('lat', 'lon', 'lat + bend', 'lon + 4e-3')} AS m FROM o UNION ALL SELECT id, 2, {sql_distance('lat + bend', 'lon + 4e-3', 'lat', 'lon + 8e-3')} FROM o)
    SELECT id, i, round(sum(m) OVER (PARTITION BY id ORDER BY i), 2) AS metres FROM v""",
)
def w10_polyline_arc_length(spark, sf_dir):
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    legs = G.waterways(spark, sf_dir).select("id", F.posexplode(shape.segments_of(F.col("line"))).alias("p", "s"))
    metres = haversine(F.col("s.a.y"), F.col("s.a.x"), F.col("s.b.y"), F.col("s.b.x"))
    return legs.select("id", (F.col("p") + 1).alias("i"), metres.alias("m")).select("id", "i", F.round(F.sum("m").over(w), 2).alias("metres"))


_SNAPPED = f"""{_COMPONENTS}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1),
n AS (SELECT node, size, c.component = (SELECT arg_min(component, {{'a': -size, 'b': component}}) FROM z) AS main, {sql_lat('node')} AS lat, {sql_lon('node')} AS lon FROM c JOIN z USING (component)),
ends AS (SELECT id, arg_min(node, {{'far': m > 300e0, 'm': m, 'node': node}}) AS node FROM (
  SELECT o.id AS id, n.node AS node, size, main, {sql_distance('o.lat', 'o.lon', 'n.lat', 'n.lon')} AS m FROM o, n)
  WHERE (m <= 300e0 AND (size >= 5 OR main)) OR (m > 300e0 AND m <= 1200e0 AND size >= 5) GROUP BY id)"""
_TRIPS = [(1, 40.62, -74.0, 40.75, -73.85), (2, 40.7, -73.9, 40.71, -73.91), (3, 40.7, -73.9, 41.9, -73.9), (4, 45.0, -73.9, 45.1, -73.9)]


@query(
    "n09_route",
    f"""WITH RECURSIVE t AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}e0, {b}e0, {c}e0, {d}e0)" for i, a, b, c, d in _TRIPS)}) v(trip, a, b, x, y)),
    k AS (SELECT *, {sql_distance('a', 'b', 'x', 'y')} > 2e0 * 59700e0 / 125e-2 AS far FROM t),
    o AS (SELECT trip * 2 AS id, a AS lat, b AS lon FROM k WHERE NOT far UNION ALL SELECT trip * 2 + 1, x, y FROM k WHERE NOT far), {_SNAPPED},
    {_COSTS.replace(_EDGES + ', ', '')}, {_reach_sql(None, "SELECT DISTINCT node AS origin, node FROM ends WHERE id % 2 = 0")}
    SELECT trip AS id, CASE WHEN far THEN 'too_long' WHEN f.node IS NULL OR g.node IS NULL THEN 'no_graph' WHEN r.seconds IS NULL THEN 'no_route' ELSE 'ok' END AS status, round(r.seconds, 3) AS duration
    FROM k LEFT JOIN ends f ON f.id = trip * 2 LEFT JOIN ends g ON g.id = trip * 2 + 1 LEFT JOIN r ON r.origin = f.node AND r.node = g.node""",
)
def n09_route(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    trips = spark.createDataFrame(_TRIPS, "id int, from_lat double, from_lon double, to_lat double, to_lon double")
    return R.route(directed, _nodes(spark, sf_dir), trips, "drive").select("id", "status", F.round("duration", 3).alias("duration"))


@query(
    "n08_isochrone",
    f"""WITH RECURSIVE o AS (SELECT * FROM (VALUES (1, 407e-1, -739e-1), (2, 4061e-2, -7402e-2)) v(id, lat, lon)), {_SNAPPED},
    {_COSTS.replace(_EDGES + ', ', '')}, {_reach_sql('55e-1', "SELECT DISTINCT node AS origin, node FROM ends")}
    SELECT o.id AS id, count(*) AS reachable_nodes, round(max({sql_distance('o.lat', 'o.lon', 'n.lat', 'n.lon')}), 1) AS max_radius FROM o JOIN ends ON ends.id = o.id JOIN r ON r.origin = ends.node JOIN n ON n.node = r.node GROUP BY o.id""",
)
def n08_isochrone(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "drive", _SPEED)
    points = spark.createDataFrame([(1, 40.7, -73.9), (2, 40.61, -74.02)], "id int, lat double, lon double")
    found = R.isochrone(directed, _nodes(spark, sf_dir), points, 5.5)
    return found.select("id", "reachable_nodes", F.round("max_radius", 1).alias("max_radius"))


@query(
    "n11_optimise_route",
    f"""WITH RECURSIVE {_WALKS}, {_reach_sql(None, "SELECT i AS origin, i AS node FROM range(4) t(i)")},
    t AS (SELECT a.i AS a, b.i AS b, c.i AS c FROM range(1, 4) a(i), range(1, 4) b(i), range(1, 4) c(i) WHERE a.i <> b.i AND a.i <> c.i AND b.i <> c.i),
    s AS (SELECT '0,' || a || ',' || b || ',' || c AS tour, w.seconds + x.seconds + y.seconds + z.seconds AS seconds FROM t JOIN r w ON w.origin = 0 AND w.node = a
      JOIN r x ON x.origin = a AND x.node = b JOIN r y ON y.origin = b AND y.node = c JOIN r z ON z.origin = c AND z.node = 0)
    SELECT tour, round(seconds, 3) AS seconds FROM s WHERE seconds <= (SELECT min(seconds) FROM s) + 1e-6 ORDER BY tour LIMIT 1""",
)
def n11_optimise_route(spark, sf_dir):
    directed = R.costs(G.road_edges(spark, sf_dir), "walk")
    stops = spark.range(4).select("id", G.key_lat(F.col("id")).alias("lat"), G.key_lon(F.col("id")).alias("lon"))
    return R.optimise(directed, stops, "walk").select("tour", F.round("seconds", 3).alias("seconds"))


@query(
    "n14_meeting_seed",
    f"""WITH RECURSIVE o AS (SELECT * FROM (VALUES (1, 406e-1, -740e-1, 14e-1), (2, 407e-1, -739e-1, 8e0), (3, 408e-1, -738e-1, 42e-1)) t(id, olat, olon, speed)),
    w(i, lat, lon) AS (SELECT 0, (SELECT avg(olat) FROM o), (SELECT degrees(atan2(sum(sin(radians(olon))), sum(cos(radians(olon))))) FROM o) UNION ALL
      SELECT w.i + 1, w.lat + (n.f.a - w.lat) * 5e-1 * pow(85e-2, w.i), w.lon + (n.f.b - w.lon) * 5e-1 * pow(85e-2, w.i)
      FROM w, LATERAL (SELECT arg_max({{'a': olat, 'b': olon}}, {sql_distance('w.lat', 'w.lon', 'olat', 'olon')} / speed) AS f FROM o) n WHERE w.i < 20)
    SELECT round(lat, 8) AS lat, round(lon, 8) AS lon FROM w WHERE i = 20""",
)
def n14_meeting_seed(spark, sf_dir):
    lat, lon = R.meeting_seed([(40.6, -74.0, R.WALK), (40.7, -73.9, R.DRIVE_DEFAULT), (40.8, -73.8, R.CYCLE)])
    return spark.range(1).select(F.round(F.lit(lat), 8).alias("lat"), F.round(F.lit(lon), 8).alias("lon"))
