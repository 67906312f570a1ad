"""Composed operators against brute force: storage, reach, routes, search, ranking."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralattice.functions import shape
from terralattice.functions.geo import radius_box
from terralattice.operators import answers, graph, names, places, search
from terralattice.sources import catalog, scratch, tiles


def boxed(spark, n=400):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    point = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    return df.withColumn("bbox", point), rows


BOX = (-0.2, -0.2, 0.1, 0.3)


def inside(rows, box=BOX):
    return {i for i, x, y in rows if box[0] <= x <= box[2] and box[1] <= y <= box[3]}


def test_pruned_scan_reads_only_files_that_meet_the_box(spark, tmp_path):
    df, rows = boxed(spark)
    path = f"file://{tmp_path}/places"
    df.repartitionByRange(12, "lon").write.parquet(path)
    manifest = tiles.footer_manifest(spark, path)
    assert manifest.agg(F.sum("n_rows")).first()[0] == len(rows)
    found = tiles.pruned_scan(spark, path, BOX, manifest)
    assert {r["id"] for r in found.collect()} == inside(rows)
    assert 0 < len(found.inputFiles()) < len(tiles.parquet_files(spark, path))
    # No file meets this box, so all are read, and the answer is empty.
    assert tiles.pruned_scan(spark, path, (5, 5, 6, 6), manifest).collect() == []


def test_footers_without_statistics_reach_over_the_world(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    one = pa.table({"id": [1], "bbox": [{"xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}]})
    pq.write_table(one, f"{tmp_path}/a.parquet", write_statistics=False)
    pq.write_table(one, f"{tmp_path}/b.parquet")
    got = {r["file"][-9:]: (r["xmin"], r["ymax"], r["n_rows"]) for r in tiles.footer_manifest(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.parquet": (-180.0, 90.0, 1), "b.parquet": (0.0, 1.0, 1)}


def test_tiles_are_warmed_resolved_and_evicted(spark, tmp_path):
    df, rows = boxed(spark)
    source, cache = f"file://{tmp_path}/source", f"file://{tmp_path}/cache"
    df.write.parquet(source)
    assert not tiles.is_cached(spark, cache, BOX)
    wanted = tiles.tiles_for_box(BOX)
    written = tiles.prewarm(df, cache, BOX)
    assert written == wanted
    way, found = tiles.resolve(spark, BOX, source, cache)
    assert way == "tiles" and {r["id"] for r in found.collect()} == inside(rows)
    assert tiles.prewarm(df, cache, BOX) == []
    gone = tiles.evict(spark, cache, 0, keep=(wanted[0],))
    assert len(gone) == len(wanted) - 1 and tiles.is_cached(spark, cache, (BOX[0], BOX[1], BOX[0] + 0.01, BOX[1] + 0.01)) == (wanted[0] == (-1, -1))
    assert tiles.resolve(spark, BOX, source, cache)[0] == "scan"


def test_warmed_tiles_hold_only_what_the_box_asked_for_whole(spark, tmp_path):
    """A tile is written whole, though the box meets only a part of it."""
    df, rows = boxed(spark)
    cache = f"file://{tmp_path}/cache"
    tiles.prewarm(df, cache, (0.01, 0.01, 0.02, 0.02))
    wide = (0.0, 0.0, 0.2499, 0.2499)
    assert tiles.is_cached(spark, cache, wide)
    assert {r["id"] for r in tiles.read_tiles(spark, cache, wide).collect()} == inside(rows, wide)


def test_catalog_releases_and_overrides(spark, tmp_path, monkeypatch):
    for release in ("2024-01-15.2", "2024-01-15.10", "2023-12-01.0", "junk"):
        spark.range(1).selectExpr("CAST(id AS STRING) AS id").write.parquet(f"{tmp_path}/{release}/theme=places/type=place")
    base = f"file://{tmp_path}"
    found = catalog.Catalog(spark, base)
    assert found.releases() == ["2024-01-15.10", "2024-01-15.2", "2023-12-01.0"] and found.release == "2024-01-15.10"
    assert set(catalog.PLACES.columns) <= set(found.read(catalog.PLACES).columns)
    other = catalog.Catalog(spark, base, "2023-12-01.0", {("2024-01-15.10", "place"): "elsewhere"})
    assert other.where(catalog.PLACES).endswith("2023-12-01.0/theme=places/type=place")
    monkeypatch.setenv("TERRALATTICE_RELEASE", "2024-01-15.2")
    assert catalog.Catalog(spark, base).release == "2024-01-15.2"
    monkeypatch.delenv("TERRALATTICE_RELEASE")
    assert catalog.Catalog(spark, "file:///nowhere", pinned="x").release == "x"


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def brute_loops(cells):
    sides = sum((a + dx, b + dy) not in cells for a, b in cells for dx, dy in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    return sides


def test_longest_loop_goes_around_the_cells():
    rng = random.Random(4)
    for _ in range(30):
        cells = {(0, 0)}
        while len(cells) < 25:
            a, b = rng.choice(sorted(cells))
            dx, dy = rng.choice(((0, 1), (1, 0), (0, -1), (-1, 0)))
            cells.add((a + dx, b + dy))
        loop = graph.longest_loop(cells)
        steps = list(zip(loop, [*loop[1:], loop[0]]))
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in steps) and len(set(steps)) == len(steps)
        # Around with the cells on the left: the area is theirs and that of the holes.
        area = sum(a * d - b * c for (a, b), (c, d) in steps) / 2
        assert area >= 1 and len(loop) <= brute_loops(cells)
    square = {(a, b) for a in range(3) for b in range(3)} - {(1, 1)}
    assert len(graph.longest_loop(square)) == 12


def test_hull_by_splitting():
    rng = random.Random(6)
    for _ in range(60):
        points = [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(rng.randrange(1, 40))]
        ring = shape.hull_of(points)
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        if not ring:
            base = sorted(set(points))
            assert len(base) < 3 or all(cross(base[0], base[-1], p) == 0 for p in base)
            continue
        n = len(ring)
        assert all(cross(ring[i], ring[(i + 1) % n], ring[(i + 2) % n]) > 0 for i in range(n))  # strictly convex, to the left
        assert all(cross(ring[i], ring[(i + 1) % n], p) >= 0 for i in range(n) for p in points)
        assert set(ring) <= set(points)


def test_hull_of_hulls(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(500)] + [("c", 1.0, 1.0), ("c", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {r["k"]: [(v["x"], v["y"]) for v in r["hull"]] for r in shape.hulls(df, "k", "x", "y").collect()}
    for k in "ab":
        assert sorted(got[k]) == sorted(shape.hull_of([(x, y) for c, x, y in rows if c == k]))
    assert got["c"] == []


def town(spark, n=8, step=0.002):
    """A square grid of streets; walking a block takes the same everywhere."""
    node = lambda i, j: i * n + j
    rows = [(node(i, j), 0.0 + i * step, 0.0 + j * step) for i in range(n) for j in range(n)]
    edges = [(node(i, j), node(i + 1, j), 200.0) for i in range(n - 1) for j in range(n)]
    edges += [(node(i, j), node(i, j + 1), 200.0) for i in range(n) for j in range(n - 1)]
    nodes = spark.createDataFrame([(k, 0, n * n, a, b) for k, a, b in rows], "node long, component long, size long, lat double, lon double")
    streets = spark.createDataFrame([(a, b, m, "residential", False) for a, b, m in edges], "src long, dst long, metres double, class string, oneway boolean")
    return nodes, graph.costs(streets, "walk")


def test_isochrone_in_a_grid_town(spark):
    nodes, directed = town(spark)
    points = spark.createDataFrame([(1, 0.0070001, 0.007), (2, 0.0, 0.0)], "id int, lat double, lon double")
    got = {r["id"]: r for r in graph.isochrone(directed, nodes, points, 3 * 200 / graph.WALK + 1).collect()}
    # Within three blocks of a corner lie 10 nodes.
    assert got[2]["reachable_nodes"] == 10 and got[2]["method"] == "concave_boundary"
    assert got[1]["reachable_nodes"] == 25
    assert all(len(r["ring"]) >= 4 and r["area_km2"] > 0 for r in got.values())
    few = graph.isochrone(directed, nodes, points.filter("id = 2"), 200 / graph.WALK + 1).first()
    assert (few["reachable_nodes"], few["method"], len(few["ring"])) == (3, "convex_hull", 3)


def test_routes_and_tours_in_a_grid_town(spark):
    nodes, directed = town(spark)
    trips = [(1, 0.0, 0.0, 0.004, 0.006), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 0.05, 0.05)]
    frame = spark.createDataFrame(trips, "id int, from_lat double, from_lon double, to_lat double, to_lon double")
    got = {r["id"]: r for r in graph.route(directed, nodes, frame, "walk").collect()}
    assert (got[1]["status"], got[1]["distance"]) == ("ok", 1000.0) and math.isclose(got[1]["duration"], 1000 / graph.WALK)
    assert got[2]["status"] == "too_long" and got[3]["status"] in ("no_graph", "too_long")
    pairs = spark.createDataFrame([(0, 63), (0, 0), (5, 5)], "origin long, destination long")
    ways = graph.fastest_paths(directed, pairs).collect()
    to_end = sorted((r["step"], r["node"], r["metres"]) for r in ways if (r["origin"], r["destination"]) == (0, 63))
    assert len(to_end) == 15 and to_end[-1] == (14, 63, 2800.0) and to_end[0] == (0, 0, 0.0)
    stops = nodes.filter("node IN (0, 7, 56, 63)").select(F.col("node").alias("id"), "lat", "lon")
    tour = graph.optimise(directed, stops, "walk").first()
    assert tour["estimated"] == 0 and math.isclose(tour["seconds"], 5600 / graph.WALK) and tour["tour"] == "0,7,63,56"


def test_tour_estimates_legs_that_nothing_joins(spark):
    nodes, directed = town(spark, n=2)
    stops = nodes.select(F.col("node").alias("id"), "lat", "lon").unionAll(spark.createDataFrame([(99, 0.5, 0.5)], "id long, lat double, lon double"))
    tour = graph.optimise(directed, stops, "walk", round_trip=False).first()
    assert tour["estimated"] == 1 and tour["tour"].endswith("99")


def test_snap_rules(spark):
    metres = 1 / 111_320
    nodes = [(1, 1, 2, 0.0, 100 * metres), (2, 2, 9, 0.0, 250 * metres), (3, 2, 9, 1.0, 1000 * metres), (4, 3, 3, 1.0, 310 * metres), (5, 3, 3, 2.0, 0.0)]
    frame = spark.createDataFrame(nodes, "node long, component long, size long, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 3.0, 0.0)], "id int, lat double, lon double")
    got = {r["id"]: r["node"] for r in graph.snap(points, frame).collect()}
    # A fragment nearby gives way; far out only large components count; a fragment alone is none.
    assert got == {1: 2, 2: 3}
    alone = spark.createDataFrame([(7, 7, 2, 0.0, 10 * metres)], frame.schema)
    assert {r["id"]: r["node"] for r in graph.snap(points, alone).collect()} == {1: 7}  # the largest component, if near


def test_nearest_join_widens(spark):
    rng = random.Random(8)
    left = [(i, rng.uniform(40, 40.2), rng.uniform(-1, -0.8)) for i in range(60)]
    right = [(i, rng.uniform(40, 40.2), rng.uniform(-1, -0.8)) for i in range(90)]
    schema = "id long, lat double, lon double"
    got = {}
    for r in places.nearest_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 3000.0, k=3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["near_id"]

    def away(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for a in left:
        near = sorted((away(a, b), b[0]) for b in right if away(a, b) <= 3000)[:3]
        assert got.get(a[0], {}) == {k + 1: b for k, (_, b) in enumerate(near)}


def test_rows_are_numbered_without_one_task_for_all(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [r["number"] for r in places.numbered(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_geocode_broadcasts_no_names(spark, tmp_path):
    # Two columns of the names are small by the estimate, so Spark broadcasts them unless the join says otherwise.
    rows = [(i, f"Spring {i}", "locality", "US-IL", i, 1) for i in range(50)]
    spark.createDataFrame(rows, "id long, name string, subtype string, region string, population long, depth int").write.parquet(f"{tmp_path}/names")
    df = spark.read.parquet(f"{tmp_path}/names")
    asked = spark.createDataFrame([("spring 7",), ("alias 3",)], "query string")
    aliases = df.select("id", F.concat(F.lit("alias "), F.col("id").cast("string")).alias("folded"))
    found = search.geocode(df, aliases, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [id#") >= 2 and "BroadcastHashJoin [id#" not in plan
    assert {(r["query"], r["id"]) for r in found.filter("rank = 1").collect()} == {("spring 7", 7), ("alias 3", 3)}


def test_equal_legs_tie_whatever_their_order(spark):
    # Summed from the left, the second place's legs come to a last digit less; both are as good, so the id decides.
    legs = [10153.95603515707, 1146.31693501039, 9912.194924115527]
    rows = [(1, i, s) for i, s in enumerate(legs)] + [(2, i, s) for i, s in enumerate(reversed(legs))]
    got = graph.meeting_rank(spark.createDataFrame(rows, "place int, origin int, seconds double").coalesce(1)).collect()
    assert {r["place"]: r["rank"] for r in got} == {1: 1, 2: 2}
    assert len({r["total"] for r in got}) == 1


def test_validation_errors():
    assert places.checked_point(1, -180) == (1.0, -180.0)
    for bad in ((91, 0), (0, 181), (float("nan"), 0), ("1", 0), (True, 0)):
        with pytest.raises(ValueError, match="finite number"):
            places.checked_point(*bad)
    with pytest.raises(ValueError, match="between 0 and 1"):
        places.confident(1.5)
    assert radius_box(0, 0, 0) == (0, 0, 0, 0)


def test_budget_keeps_one_row_and_strips_it(spark):
    rows = [(1, "a" * 20, "cat", 0.5), (2, "b" * 20, "cat", 0.6)]
    df = spark.createDataFrame(rows, "id int, name string, category string, confidence double")
    fit = lambda n: [tuple(r) for r in answers.fit_budget(df, ["id"], n).orderBy("id").collect()]
    import json

    whole = [dict(zip(df.columns, r)) for r in rows]
    tokens = len(json.dumps(whole)) // 4
    assert fit(tokens) == rows and fit(tokens - 1) == rows[:1]
    one = dict(whole[0])
    one.pop("confidence")
    assert fit(len(json.dumps([one])) // 4) == [(1, "a" * 20, "cat", None)]
    assert fit(1) == [(1, "a" * 20, None, None)]


def test_ladder_stands_down_by_rungs(spark):
    schema = "id long, name string, subtype string, region string, population long, depth int, common map<string,string>"
    rows = [
        (1, "Saint Louis", "locality", "US-MO", 300_000, 2, {"a": "STL"}),
        (2, "St. Louis", "locality", "US-MI", None, 2, None),
        (3, "Berkeley", "locality", "US-CA", 120_000, 2, None),
        (4, "Portland", "locality", "US-OR", 600_000, 2, None),
        (5, "Portland", "locality", "US-ME", 68_000, 2, None),
        (6, "New Portland Heights", "locality", "US-OR", 9_000_000, 2, None),
    ]
    df = spark.createDataFrame(rows, schema)
    asked = [("St. Louis",), ("stl",), ("Berekley",), ("portland",), ("Portland, Maine",), ("Atlantis",)]
    got = {}
    for r in search.geocode(df, names.alternate_names(df), spark.createDataFrame(asked, "query string")).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == {"St. Louis": [2], "stl": [1], "Berekley": [3], "portland": [4, 5, 6], "Portland, Maine": [5]}


def test_addresses_by_street_forms(spark):
    rows = [(1, "12", "MARKET ST", "1", "a", 0.1, 0.1), (2, "12", "MARKET ST", "1", "b", 0.1, 0.1), (3, "14", "MARKET ST NW", "1", None, 0.2, 0.2), (4, "12", "MARKET ST", "2", None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, number string, street string, postcode string, unit string, lat double, lon double")
    anchors = spark.createDataFrame([("Town", 0.0, 0.0, 1.0, 1.0, 0.1, 0.1), ("State", 0.0, 0.0, 9.0, 9.0, 4.0, 4.0)], "name string, xmin double, ymin double, xmax double, ymax double, lat double, lon double")
    asked = spark.createDataFrame([("Market Street, Town",), ("12 market st, TOWN",), ("Market Street, State",), ("Market Street",)], "query string")
    got = {}
    for r in search.find_addresses(df, anchors, asked).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["number"], r["street"], r["unit"]))
    assert got == {"Market Street, Town": [("12", "MARKET ST", None), ("14", "MARKET ST NW", None)], "12 market st, TOWN": [("12", "MARKET ST", None)]}


def test_graphs_are_reused_inside_their_box(spark):
    made = []

    def build(box, mode):
        made.append((box, mode))
        return spark.range(len(made)).selectExpr("id AS src", "id AS dst")

    cache = graph.GraphCache(most=2)
    first = cache.get((0, 0, 1, 1), "walk", build)
    assert made[0][0] == pytest.approx((-0.15, -0.15, 1.15, 1.15))
    assert cache.get((0.1, 0.1, 1.1, 1.1), "walk", build) is first and len(made) == 1
    cache.get((0, 0, 1, 1), "drive", build)
    cache.get((5, 5, 6, 6), "walk", build)
    assert len(made) == 3 and first.storageLevel.useDisk is False  # the oldest went
    cache.get((0, 0, 1, 1), "walk", build)
    assert len(made) == 4


def test_even_samples_and_nearest_ranks(spark):
    from terralattice.operators import areas

    df = spark.range(101).select((F.col("id") * 37 % 101).alias("v"))
    assert sorted(r["v"] for r in graph.even_sample(df, 5, ["v"]).collect()) == [0, 25, 50, 75, 100]
    assert graph.even_sample(df, 1, ["v"]).count() == 1 and graph.even_sample(df.limit(3), 9, ["v"]).count() == 3
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(40)) for _ in range(300)] + [("c", 5), ("c", None)]
    got = {r["k"]: r["v"] for r in areas.nearest_rank(spark.createDataFrame(rows, "k string, v int"), "k", "v", 0.95).collect()}
    for k in "abc":
        values = sorted(v for c, v in rows if c == k and v is not None)
        assert got[k] == values[max(math.ceil(0.95 * len(values)), 1) - 1]


def test_remote_options():
    from terralattice.sources import remote

    assert "spark.hadoop.fs.s3a.aws.credentials.provider" in remote.options() and len(remote.options(anonymous=False)) == len(remote.options()) - 1


def test_searches_in_tasks_and_by_joins_agree(spark):
    rng = random.Random(12)
    edges = {(rng.randrange(60), rng.randrange(60)): float(rng.randrange(1, 9)) for _ in range(180)}
    directed = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items() if a != b], "src long, dst long, seconds double")
    sources = spark.createDataFrame([(1, 1), (2, 2), (2, 5), (99, 99)], "origin long, node long")
    for budget in (6.0, math.inf):
        rows = [{tuple(r) for r in graph.reachable(directed, sources, budget, small).collect()} for small in (0, 10**6)]
        assert rows[0] == rows[1] and (99, 99, 0.0) in rows[0]
        for origin, starts in ((1, (1,)), (2, (2, 5))):
            best = {}
            for s in starts:
                for node, d in graph.shortest(graph.adjacency_of((a, b, w) for (a, b), w in edges.items() if a != b), s, budget)[0].items():
                    best[node] = min(d, best.get(node, math.inf))
            assert {(n, d) for o, n, d in rows[0] if o == origin} == set(best.items())
