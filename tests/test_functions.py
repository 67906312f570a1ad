"""Functions against closed forms and brute force."""

import itertools
import math
import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralattice.functions import geo, shape, text
from terralattice.operators import graph, places
from terralattice.sources import catalog, tiles


def test_radius_box_and_seam():
    xmin, ymin, xmax, ymax = geo.radius_box(0.0, 179.95, 11132.0)
    assert xmax > 180 and geo.split_at_seam((xmin, ymin, xmax, ymax))[1][0] == -180
    assert geo.radius_box(89.99, 0.0, 50_000.0)[3] == 90.0
    assert geo.clamp_radius(math.inf) == 0.0 and geo.clamp_radius(1e9) == 500_000.0


def test_within_keeps_the_rim(spark):
    # Due north the first lies 19,984 m away, beyond a box of 111,320 m to a degree; the others on the rim of wide circles at high latitudes.
    spots = [(1, 40.7, -73.9, 40.87968, -73.9), (2, 70.0, 179.9, 70.8, -171.3), (3, 89.9, 0.0, 89.95, 180.0), (4, 0.0, 0.0, 0.0, 0.1797)]
    for i, a, b, lat, lon in spots:
        df = spark.createDataFrame([(i, lat, lon), (-i, -lat - 20, lon)], "id int, lat double, lon double")
        metres = df.filter("id > 0").select(geo.haversine(F.lit(a), F.lit(b), F.col("lat"), F.col("lon"))).first()[0]
        assert [r["id"] for r in places.within(df, a, b, metres).collect()] == [i]
        assert places.within(df, a, b, metres * (1 - 1e-6)).collect() == []


def test_tiles_at_seam():
    found = tiles.tiles_for_box((179.9, 0.1, 180.1, 0.2), 0.25)
    assert found == [(-720, 0), (719, 0)]
    assert tiles.tiles_for_box((-180, -90, 180, 90), 0.25) is None


def test_cells_find_neighbours_over_the_seam(spark):
    a = spark.createDataFrame([(1, 10.0, 179.9999), (2, 60.0, 0.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([(7, 10.0, -179.9999), (8, 60.0005, 0.0005), (9, 61.0, 0.0)], "id long, lat double, lon double")
    found = {(r["id"], r["near_id"]) for r in places.nearest_join(a, b, 150.0).collect()}
    assert found == {(1, 7), (2, 8)}


def test_nearest_join_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    points = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(150)]
    points += [(1000 + i, lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.01, 0.01)) for i, lat, lon in points]

    def metres(a, b):
        p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        return 2 * geo.EARTH_RADIUS * math.asin(math.sqrt(h))

    left, right = points[:150], points[150:]
    frame = lambda p: spark.createDataFrame(p, "id long, lat double, lon double")
    mine = {(r["id"], r["near_id"]) for r in places.nearest_join(frame(left), frame(right), 1000.0).collect()}
    want = set()
    for a in left:
        near = [(metres(a, b), b[0]) for b in right if metres(a, b) <= 1000.0]
        if near:
            want.add((a[0], min(near)[1]))
    assert mine == want


def test_polygon_with_hole(spark):
    ring = lambda *p: F.array(*(shape.vertex(F.lit(x), F.lit(y)) for x, y in p))
    polygon = F.array(ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2)))
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (4.0, 2.0), (5.0, 1.0), (0.0, 0.0)], "x double, y double")
    got = [r[0] for r in df.select(shape.contains(polygon, F.col("x"), F.col("y"))).collect()]
    assert got == [True, False, False, False, False]
    assert spark.range(1).select(shape.area(polygon)).first()[0] == 15.0


def test_wkb_round_trip(spark):
    data = shape.encode_wkb_polygon([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]])
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 1, 2, 3, 4)
    df = spark.createDataFrame([(bytearray(data),), (bytearray(line),), (None,)], "g binary")
    got = df.select(shape.decode_wkb("g").alias("s")).collect()
    assert got[0]["s"]["kind"] == "polygon" and len(got[0]["s"]["parts"][0][0]) == 4
    assert got[1]["s"]["kind"] == "line" and got[1]["s"]["parts"][0][0][1]["y"] == 4.0
    assert got[2]["s"] is None or got[2]["s"]["kind"] is None


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.integers(0, 6)] * 4), st.tuples(*[st.integers(0, 6)] * 4))
def test_overlap_of_boxes(a, b):
    box = lambda t: (min(t[0], t[1]), min(t[2], t[3]), max(t[0], t[1]) + 1, max(t[2], t[3]) + 1)
    (ax, ay, bx, by), (cx, cy, dx, dy) = box(a), box(b)
    rings = lambda x, y, u, v: [[(x, y), (u, y), (u, v), (x, v)]]
    want = max(0, min(bx, dx) - max(ax, cx)) * max(0, min(by, dy) - max(ay, cy))
    assert abs(shape.overlap_area_of(rings(ax, ay, bx, by), rings(cx, cy, dx, dy)) - want) < 1e-9


def test_overlap_of_triangles():
    assert shape.overlap_area_of([[(0, 0), (2, 0), (1, 2)]], [[(0, 1), (2, 1), (1, -1)]]) == pytest.approx(1.25)


def test_hull_and_circle():
    assert len(shape.hull_of([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])) == 4
    assert shape.hull_of([(0, 0), (1, 1), (2, 2)]) == []
    x, y, r = shape.enclosing_circle([(0, 0), (2, 0), (1, 0.2)])
    assert (x, y, r) == pytest.approx((1, 0, 1))


def brute_radius(points):
    best = math.inf
    for some in [*itertools.combinations(points, 2), *itertools.combinations(points, 3)]:
        (ax, ay), (bx, by), *more = some
        x, y = (ax + bx) / 2, (ay + by) / 2
        if more:
            (cx, cy) = more[0]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            if not d:
                continue
            x = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
            y = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        best = min(best, max(math.hypot(px - x, py - y) for px, py in points))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=2, max_size=9, unique=True))
def test_circle_against_all_pairs_and_triples(points):
    assert shape.enclosing_circle(points)[2] == pytest.approx(brute_radius(points), rel=1e-9)


def test_circles_of_many_points(spark):
    # 3,000 points a group have 4.5e9 triples; on a line the two ends count.
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(10_000)), float(rng.randrange(10_000))) for g in range(4) for _ in range(3000)]
    rows += [(9, float(i), 3.0 * i) for i in range(5)] + [(10, 7.0, 7.0)] * 2
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    began = time.time()
    got = {r["g"]: r["circle"] for r in shape.circles(df, "g", "x", "y").collect()}
    assert time.time() - began < 60
    for g, (x, y, r) in got.items():
        away = sorted((math.hypot(a - x, b - y) for k, a, b in rows if k == g), reverse=True)
        assert away[0] == pytest.approx(r, rel=1e-9) and (r == 0 or away[1] == pytest.approx(r, rel=1e-9))
    assert got[9]["r"] == pytest.approx(math.hypot(4, 12) / 2) and got[10]["r"] == 0


def test_simplify_keeps_ends():
    line = [(i / 10, math.sin(i / 10)) for i in range(60)]
    short, tolerance = shape.simplify_to_count(line, 8)
    assert len(short) <= 8 and short[0] == line[0] and short[-1] == line[-1] and tolerance > 0


def test_simplify_to_count_in_any_unit(spark):
    # The corner is a million units off, more than any tolerance that doubling from 1e-7 forty times reaches.
    assert shape.simplify_to_count([(0, 0), (1e6, 1e6), (2e6, 0)], 2)[0] == [(0, 0), (2e6, 0)]
    rng = random.Random(9)
    lines = [[(rng.random(), rng.random()) for _ in range(n)] for n in (0, 1, 2, 3, 7, 40)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in l]) for i, l in enumerate(lines)] + [(6, None)], f"id int, line {shape.RING}").coalesce(1)
    for most in (2, 3, 8):
        got = {r["id"]: r["s"] and [tuple(v) for v in r["s"]] for r in df.select("id", shape.simplified(most)(F.col("line")).alias("s")).collect()}
        assert got[6] is None
        for i, line in enumerate(lines):
            short, tolerance = shape.simplify_to_count(line, most)
            assert (got[i] or []) == short and len(short) <= most
            assert short == line or short == shape.simplify_line(line, tolerance)


def test_jaro_winkler():
    assert text.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert text.jaro_winkler_of("abc", "") == 0.0 and text.jaro_winkler_of(None, "a") is None


def test_fold(spark):
    df = spark.createDataFrame([("Łódź",), ("São",), ("Straße",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fold(F.col("t"))).collect()] == ["łodz", "sao", "straße", None]
    assert [r[0] for r in df.select(text.fold_extended(F.col("t"))).collect()] == ["lodz", "sao", "strasse", None]
    assert [r[0] for r in df.select(text.fold_exact(F.col("t"))).collect()] == ["łodz", "sao", "straße", None]


def test_tour_matches_permutations():
    import itertools
    import random

    rng = random.Random(5)
    cost = [[0 if i == j else rng.uniform(1, 9) for j in range(6)] for i in range(6)]
    for back in (True, False):
        total = lambda o: sum(cost[a][b] for a, b in zip(o, o[1:])) + (cost[o[-1]][0] if back else 0)  # noqa: B023, E731
        want = min(((0, *p) for p in itertools.permutations(range(1, 6))), key=total)
        got = graph.best_tour(cost, back)
        assert got[1] == want and got[0] == pytest.approx(total(want))


def test_shortest_path():
    roads = graph.adjacency_of([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)])
    best, before = graph.shortest(roads, 1, budget=2.5)
    assert best == {1: 0.0, 2: 1.0, 3: 2.0} and graph.path_to(before, 3) == [1, 2, 3]


def test_segments_to_edges(spark):
    df = spark.sql(
        "SELECT 's' AS id, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0.01D, 'y', 0D)) AS line,"
        " array(named_struct('connector_id', 'a', 'at', 0D), named_struct('connector_id', 'm', 'at', 0.25D)) AS connectors"
    )
    got = {(r["src"], r["dst"]): r["metres"] for r in graph.from_segments(df).collect()}
    assert set(got) == {("a", "m"), ("m", "pt_0.01_0.0")}
    assert got["m", "pt_0.01_0.0"] == pytest.approx(3 * got["a", "m"])


def test_releases_sort_by_patch_number():
    assert catalog.sorted_releases(["2026-07-22.9/", "2026-07-22.10/", "2025-01-01.0", "x"]) == ["2026-07-22.10", "2026-07-22.9", "2025-01-01.0"]


def test_conform_and_taxonomy(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿code; path\ncafe; [food,cafe]\n", encoding="utf-8")
    got = catalog.read_taxonomy(spark, str(tmp_path / "t.csv")).collect()
    assert got[0]["slug"] == "cafe" and got[0]["path"] == ["food", "cafe"]
    df = catalog.conform(spark.range(1), {"name": "string"})
    assert df.columns == ["id", "name"] and catalog.fingerprint(df) == catalog.fingerprint(df.select("name", "id"))


def test_bbox_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(10).select(
        "id", F.struct(*(F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"), F.lit(b"0").alias("geometry")
    )
    path = str(tmp_path / "p")
    df.write.parquet(path)
    plan = spark.read.parquet(path).filter(geo.box_meets("bbox", (2.0, 2.0, 4.0, 4.0))).select("id")
    said = plan._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmax" in said and "PushedFilters" in said and "geometry" not in said
    assert sorted(r[0] for r in plan.collect()) == [2, 3, 4]


def test_stream_counts_late_events(spark, tmp_path):
    import datetime as dt

    from terralattice.streaming.events import stream_hourly

    t = dt.datetime(2024, 1, 1, 10, 30)
    rows = [(1, t, 1, "click", 2.0, "{}"), (1, t, 1, "click", 2.0, "{}"), (2, t, 2, "click", 3.0, "{}")]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream_hourly(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("hours").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT n, total FROM hours").collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 5.0)]
