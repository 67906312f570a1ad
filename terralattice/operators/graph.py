"""Street graphs: building, costs, components, snapping, bounded searches, tours, corridors, meeting points."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralattice.functions.geo import EARTH_RADIUS, METRES_PER_DEGREE, covering_cells, grid_cell, haversine
from terralattice.functions.shape import RING, closest_point, distance_to_line, hull_of, length_m, segments_of
from terralattice.operators.places import numbered
from terralattice.sources.scratch import use_checkpoints

# Metres per second by mode and road class, classes that a mode cannot use, snapping radii, planning factors, largest radii.
WALK, CYCLE, DRIVE_DEFAULT = 1.4, 4.2, 8.0
CLASS_SPEED = {
    "motorway": 27.0,
    "motorway_link": 20.0,
    "trunk": 24.0,
    "trunk_link": 18.0,
    "primary": 13.0,
    "primary_link": 11.0,
    "secondary": 11.0,
    "secondary_link": 9.0,
    "tertiary": 9.0,
    "tertiary_link": 8.0,
    "residential": 8.0,
    "living_street": 4.0,
    "service": 5.0,
    "unclassified": 8.0,
}
EXCLUDED = {
    "walk": ("motorway", "motorway_link", "trunk", "trunk_link"),
    "cycle": ("motorway", "motorway_link", "trunk", "trunk_link"),
    "drive": ("footway", "path", "steps", "pedestrian", "cycleway"),
}
MAX_RADIUS = {"walk": 5000.0, "cycle": 15000.0, "drive": 60000.0}
PADDING, SNAP_NEAR, SNAP_FAR, SNAP_COMPONENT = 1.25, 300.0, 1200.0, 5
MAX_SPAN = {mode: 2 * (radius - SNAP_NEAR) / PADDING for mode, radius in MAX_RADIUS.items()}
DETOUR = 1.4
CELL_METRES, CELL_SHARE, CONCAVE_FROM = 60.0, 40, 8
SEED_STEPS = 20
MPH, KMH = 0.44704, 1 / 3.6


def speed_limit(value: Column, unit: Column) -> Column:
    """A posted limit in m/s; km/h unless it says mph."""
    return value * F.when(F.lower(F.trim(unit)).isin("mph", "mi/h"), MPH).otherwise(KMH)


def posted_limit(limits: Column) -> Column:
    """The slowest limit (max_speed struct<value,unit>, between) of a whole segment, in m/s; those of a part of it don't count."""
    whole = F.filter(limits, lambda x: F.coalesce(F.size(x["between"]) <= 0, F.lit(True)) & (x["max_speed"]["value"] > 0))
    return F.array_min(F.transform(whole, lambda x: speed_limit(x["max_speed"]["value"], x["max_speed"]["unit"])))


def allowed(df: DataFrame, mode: str) -> DataFrame:
    """Streets that a mode can use: roads, where the subtype is known, of a class that is not excluded; unknown ones stay."""
    if "subtype" in df.columns:
        df = df.filter(F.col("subtype").isNull() | (F.col("subtype") == "road"))
    return df.filter(F.col("class").isNull() | ~F.col("class").isin(*EXCLUDED[mode]))


def directions(restrictions: Column, mode: str) -> tuple[Column, Column]:
    """Whether a segment may be used along and against its direction, by its denied access (access_type, when struct<heading, mode>)."""
    tokens = {"cycle": ("bicycle",), "drive": ("motorVehicle", "car", "hgv", "motorcycle")}.get(mode)
    if tokens is None:
        return F.lit(True), F.lit(True)
    meant = F.filter(
        F.coalesce(restrictions, F.array()),
        lambda r: (r["access_type"] == "denied")
        & (F.coalesce(F.size(r["when"]["mode"]) <= 0, F.lit(True)) | F.arrays_overlap(r["when"]["mode"], F.array(*map(F.lit, tokens)))),
    )
    closed = lambda other: F.exists(meant, lambda r: ~F.coalesce(r["when"]["heading"] == other, F.lit(False)))
    return ~closed("backward"), ~closed("forward")


def from_segments(segments: DataFrame) -> DataFrame:
    """Edges (src, dst, metres, + other columns) of segments (id, line, connectors array<struct<connector_id,at>>).

    Segments are cut at connectors; ends without one get an id from their rounded coordinates; an edge is as long as its share.
    """
    end = lambda v: F.concat(F.lit("pt_"), F.round(v["x"], 6).cast("string"), F.lit("_"), F.round(v["y"], 6).cast("string"))
    inner = F.filter("connectors", lambda c: (c["at"] > 0) & (c["at"] < 1))
    named = lambda at, v: F.coalesce(
        F.get(F.filter("connectors", lambda c: c["at"] == at), F.lit(0))["connector_id"], end(v)
    )
    stop = lambda at, name: F.struct(F.lit(at).cast("double").alias("at"), name.alias("node"))
    stops = F.array_sort(
        F.concat(
            F.array(stop(0.0, named(0.0, F.get("line", F.lit(0)))), stop(1.0, named(1.0, F.element_at("line", -1)))),
            F.transform(inner, lambda c: F.struct(c["at"].alias("at"), c["connector_id"].alias("node"))),
        )
    )
    pairs = F.zip_with(
        F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    rest = [c for c in segments.columns if c not in ("line", "connectors")]
    return (
        segments.select(*rest, length_m(F.col("line")).alias("_m"), F.explode(pairs).alias("_p"))
        .select(*rest, F.col("_p.a.node").alias("src"), F.col("_p.b.node").alias("dst"), ((F.col("_p.b.at") - F.col("_p.a.at")) * F.col("_m")).alias("metres"))
        .filter("src <> dst")
    )


def costs(edges: DataFrame, mode: str, class_speed: dict[str, float] | None = None) -> DataFrame:
    """Directed src, dst, seconds, metres of edges with metres, class, oneway, and a posted limit if there is one.

    Classes that the mode cannot use are left out; walking goes against one-ways.  Of several edges the fastest stays.
    """
    edges = allowed(edges, mode)
    if mode == "walk":
        seconds = F.col("metres") / WALK
    elif mode == "cycle":
        seconds = F.col("metres") / CYCLE
    else:
        speed = F.lit(DRIVE_DEFAULT)
        for name, v in (class_speed or CLASS_SPEED).items():
            speed = F.when(F.col("class") == name, v).otherwise(speed)
        if "limit" in edges.columns:
            speed = F.coalesce("limit", speed)
        seconds = F.col("metres") / speed
    there = edges.select("src", "dst", F.struct(seconds.alias("seconds"), "metres").alias("cost"), "oneway")
    back = there if mode == "walk" else there.filter(~F.coalesce("oneway", F.lit(False)))
    both = there.select("src", "dst", "cost").unionAll(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    return both.groupBy("src", "dst").agg(F.min("cost").alias("cost")).select("src", "dst", "cost.seconds", "cost.metres")


#: Directed edges up to which a graph goes to every task; larger ones are searched by joins.
SMALL_GRAPH = 2_000_000


class Compact:
    """A graph as arrays: the nodes in order, and each one's edges."""

    def __init__(self, edges):
        src, dst, seconds = (edges.column(c).to_numpy() for c in ("src", "dst", "seconds"))
        self.nodes = np.unique(np.concatenate((src, dst)))
        at = np.searchsorted(self.nodes, src)
        order = np.argsort(at, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.nodes)))))
        self.to, self.seconds = np.searchsorted(self.nodes, dst)[order], seconds[order]

    def within(self, source, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a source reaches within a budget, and the least seconds to each; itself at 0, whether it has edges or not."""
        first = int(np.searchsorted(self.nodes, source))
        if first == len(self.nodes) or self.nodes[first] != source:
            return np.array([source]), np.zeros(1)
        starts, to, cost = self.starts.tolist(), self.to.tolist(), self.seconds.tolist()
        best, done, todo = {first: 0.0}, set(), [(0.0, first)]
        while todo:
            d, u = heapq.heappop(todo)
            if u in done:
                continue
            done.add(u)
            for k in range(starts[u], starts[u + 1]):
                there, v = d + cost[k], to[k]
                if there <= budget and there < best.get(v, math.inf):
                    best[v] = there
                    heapq.heappush(todo, (there, v))
        return self.nodes[list(best)], np.array(list(best.values()))


def _reached_in_tasks(directed: DataFrame, sources: DataFrame, seconds: float) -> DataFrame:
    """A search per origin in a task of its own, on a graph of checked size that every task has."""
    shared = directed.sparkSession.sparkContext.broadcast(Compact(directed.select("src", "dst", "seconds").toArrow()))
    kind = lambda c: sources.schema[c].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for node in group["node"]:
            for n, s in zip(*shared.value.within(node, seconds)):
                found[n] = min(s, found.get(n, math.inf))
        return pd.DataFrame({"origin": group["origin"].iloc[0], "node": list(found), "seconds": list(found.values())})

    return sources.groupBy("origin").applyInPandas(run, f"origin {kind('origin')}, node {kind('node')}, seconds double")


def reachable(directed: DataFrame, sources: DataFrame, seconds: float, small: int = SMALL_GRAPH) -> DataFrame:
    """origin, node, seconds of everything within a budget of sources (origin, node).

    A graph of at most ``small`` edges, counted before, is searched per origin in tasks.  In a larger one nodes that got cheaper are relaxed by
    joins until none does.  Lineage is cut with checkpoint(), which survives lost executors.
    """
    use_checkpoints(directed.sparkSession)
    directed = directed.select("src", "dst", "seconds").checkpoint()
    sources = sources.select("origin", "node").distinct()
    if directed.count() <= small:
        return _reached_in_tasks(directed, sources, seconds).checkpoint()
    best = sources.withColumn("seconds", F.lit(0.0)).checkpoint()
    front = best
    while not front.isEmpty():
        # Only nodes that got cheaper go on, and only if the budget holds.
        step = (
            front.join(directed.withColumnRenamed("seconds", "w"), F.col("node") == F.col("src"))
            .select("origin", F.col("dst").alias("node"), (F.col("seconds") + F.col("w")).alias("seconds"))
            .filter(F.col("seconds") <= seconds)
        )
        offered = step.groupBy("origin", "node").agg(F.min("seconds").alias("offer"))
        fresh = (
            best.join(offered, ["origin", "node"], "full")
            .select("origin", "node", F.least("seconds", "offer").alias("seconds"), (F.col("seconds").isNull() | (F.col("offer") < F.col("seconds"))).alias("_better"))
            .checkpoint()
        )
        best, front = fresh.drop("_better"), fresh.filter("_better").drop("_better")
    return best


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node id each node can reach, by label exchange until nothing changes.

    Lineage is cut with checkpoint(), which survives lost executors.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("component")).withColumnRenamed("src", "node")
    use_checkpoints(edges.sparkSession)
    labels = labels.checkpoint()
    while True:
        offered = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("offer"))
        # Each node also takes its label's own label, which halves long chains.
        over = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        fresh = (
            labels.join(offered, F.col("node") == F.col("src"), "left")
            .join(over, F.col("component") == F.col("at"), "left")
            .select("node", F.least("component", "offer", "jump").alias("component"))
            .checkpoint()
        )
        settled = fresh.join(labels.withColumnRenamed("component", "old"), "node").filter("component < old").isEmpty()
        labels = fresh
        if settled:
            return labels


def search_tree(directed: DataFrame, best: DataFrame) -> DataFrame:
    """origin, node, before: the node before each reached one on a fastest way; of several the least."""
    arrived = (
        directed.select("src", "dst", F.col("seconds").alias("w"))
        .join(best.withColumnRenamed("node", "src"), "src")
        .select("origin", F.col("dst").alias("node"), F.col("src").alias("before"), (F.col("seconds") + F.col("w")).alias("arrival"))
    )
    on_time = best.filter("seconds > 0").join(arrived, ["origin", "node"]).filter(F.col("arrival") == F.col("seconds"))
    return on_time.groupBy("origin", "node").agg(F.min("before").alias("before"))


def paths(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """origin, destination, node: the nodes of the way from each origin to each (origin, destination) asked for.

    Ways grow by doubling: in each round all nodes found so far jump twice as far back, so a way of n nodes takes log n rounds.
    """
    use_checkpoints(tree.sparkSession)
    jumps = tree.checkpoint()
    found = targets.select("origin", "destination", F.col("destination").alias("node")).distinct().checkpoint()
    size = found.count()
    while True:
        back = found.join(jumps, ["origin", "node"]).select("origin", "destination", F.col("before").alias("node"))
        found = found.unionAll(back).distinct().checkpoint()
        before, size = size, found.count()
        if size == before:
            return found
        further = jumps.select("origin", F.col("node").alias("before"), F.col("before").alias("far"))
        jumps = jumps.join(further, ["origin", "before"]).select("origin", "node", F.col("far").alias("before")).checkpoint()


def fastest_paths(directed: DataFrame, pairs: DataFrame, budget: float = math.inf) -> DataFrame:
    """origin, destination, step, node, seconds, metres of the fastest ways of pairs; a pair without one has no rows."""
    origins = pairs.select("origin", F.col("origin").alias("node")).distinct()
    best = reachable(directed, origins, budget)
    asked = pairs.select("origin", "destination").distinct().join(best.withColumnRenamed("node", "destination"), ["origin", "destination"], "left_semi")
    tree = search_tree(directed, best)
    order = Window.partitionBy("origin", "destination").orderBy("seconds", "node")
    edge = directed.select(F.col("src").alias("before"), F.col("dst").alias("node"), F.col("metres").alias("_m"))
    on = paths(tree, asked).join(best, ["origin", "node"]).join(tree, ["origin", "node"], "left").join(edge, ["before", "node"], "left")
    return on.select(
        "origin",
        "destination",
        (F.row_number().over(order) - 1).alias("step"),
        "node",
        "seconds",
        F.sum(F.coalesce("_m", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("metres"),
    )


def snap(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node, distance: where a point meets the graph.

    Within 300 m the nearest node of a component of five nodes or more, or of the largest one; else, up to 1200 m, the nearest of a
    component of five or more.  ``nodes`` has node, lat, lon, and its component and the component's size.
    """
    largest = nodes.select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(1).select(F.col("component").alias("_main"))
    a = points.select("id", "lat", "lon").withColumn("_cell", F.explode(covering_cells(F.col("lat"), F.col("lon"), SNAP_FAR, SNAP_FAR)))
    b = nodes.join(F.broadcast(largest), F.col("component") == F.col("_main"), "left").select(
        "node",
        "size",
        F.col("_main").isNotNull().alias("main"),
        F.col("lat").alias("_a"),
        F.col("lon").alias("_b"),
        grid_cell(F.col("lat"), F.col("lon"), SNAP_FAR).alias("_cell"),
    )
    near = a.join(b, "_cell").withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b")))
    usable = (F.col("size") >= SNAP_COMPONENT) | (F.col("main") & (F.col("distance") <= SNAP_NEAR))
    best = F.min(F.struct((F.col("distance") > SNAP_NEAR).alias("far"), "distance", "node"))
    return near.filter((F.col("distance") <= SNAP_FAR) & usable).groupBy("id").agg(best.alias("b")).select("id", "b.node", "b.distance")


def route(directed: DataFrame, nodes: DataFrame, trips: DataFrame, mode: str) -> DataFrame:
    """id, status, duration, distance of trips (id, from_lat, from_lon, to_lat, to_lon).

    A trip is too_long beyond the mode's span, has no_graph where an end meets no street, no_route where nothing joins them, else is ok.
    """
    span = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    known = trips.withColumn("long", span > MAX_SPAN[mode])
    ends = lambda side: snap(
        known.filter("NOT long").select("id", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon")), nodes
    ).select("id", F.col("node").alias({"from": "origin", "to": "destination"}[side]))
    snapped = known.select("id", "long").join(ends("from"), "id", "left").join(ends("to"), "id", "left")
    use_checkpoints(directed.sparkSession)
    snapped = snapped.checkpoint()
    pairs = snapped.filter("origin IS NOT NULL AND destination IS NOT NULL").select("origin", "destination").distinct()
    last = fastest_paths(directed, pairs).filter("node = destination").select("origin", "destination", "seconds", "metres")
    status = (
        F.when(F.col("long"), "too_long").when(F.col("origin").isNull() | F.col("destination").isNull(), "no_graph")
        .when(F.col("seconds").isNull(), "no_route").otherwise("ok")
    )
    return snapped.join(last, ["origin", "destination"], "left").select(
        "id", status.alias("status"), F.col("seconds").alias("duration"), F.col("metres").alias("distance")
    )


def isochrone(directed: DataFrame, nodes: DataFrame, points: DataFrame, seconds: float) -> DataFrame:
    """id, reachable_nodes, max_radius, method, area_km2, ring of points (id, lat, lon): what is reached within a time.

    The ring is the longest loop around the occupied cells of a grid at the point, of max(60 m, radius / 40), within the reached nodes' box, or
    the convex hull below eight nodes.  At that cell size a point has at most some thousands of cells, so a group is bounded.
    """
    ends = snap(points, nodes).select("id", F.col("node").alias("origin"))
    best = reachable(directed, ends.select("origin", F.col("origin").alias("node")).distinct(), seconds)
    at = nodes.select("node", F.col("lat").alias("y"), F.col("lon").alias("x"))
    reached = ends.join(best, "origin").join(at, "node").join(points.select("id", "lat", "lon"), "id")
    away = haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    totals = reached.groupBy("id").agg(
        F.count(F.lit(1)).alias("reachable_nodes"), F.max(away).alias("max_radius"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
    )
    cell = F.greatest(F.lit(CELL_METRES), F.col("max_radius") / CELL_SHARE)
    high, wide = cell / 110540.0, cell / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    few = F.col("reachable_nodes") < CONCAVE_FROM
    spots = reached.join(totals, "id").select(
        "id", "lat", "lon", "reachable_nodes", "max_radius", "xmin", "xmax", "ymin", "ymax", wide.alias("wide"), high.alias("high"),
        F.when(few, F.col("x")).otherwise(F.floor((F.col("x") - F.col("lon")) / wide).cast("double")).alias("cx"),
        F.when(few, F.col("y")).otherwise(F.floor((F.col("y") - F.col("lat")) / high).cast("double")).alias("cy"),
    ).distinct()

    def outline(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        if one["reachable_nodes"] < CONCAVE_FROM:
            method, ring = "convex_hull", hull_of(zip(group["cx"], group["cy"]))
        else:
            loop = longest_loop({(int(a), int(b)) for a, b in zip(group["cx"], group["cy"])})
            clamp = lambda v, low, high: min(max(v, low), high)
            method = "concave_boundary"
            ring = [
                (clamp(one["lon"] + a * one["wide"], one["xmin"], one["xmax"]), clamp(one["lat"] + b * one["high"], one["ymin"], one["ymax"]))
                for a, b in loop
            ]
        scale = METRES_PER_DEGREE * max(math.cos(math.radians(one["lat"])), 1e-6) * 110540.0 / 1e6
        x, y = [p[0] - one["lon"] for p in ring], [p[1] - one["lat"] for p in ring]
        area = abs(sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in range(len(ring)))) / 2 * scale
        return pd.DataFrame(
            {"id": [one["id"]], "reachable_nodes": [one["reachable_nodes"]], "max_radius": [one["max_radius"]], "method": [method],
             "area_km2": [area], "ring": [[{"x": a, "y": b} for a, b in ring]]}
        )

    return spots.groupBy("id").applyInPandas(
        outline, f"id {points.schema['id'].dataType.simpleString()}, reachable_nodes long, max_radius double, method string, area_km2 double, ring {RING}"
    )


def longest_loop(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest closed way along the sides of cells that border on empty ones, with the cells on its left; open at its end."""
    sides = {}
    for a, b in cells:
        for (dx, dy), start, end in (
            ((0, -1), (a, b), (a + 1, b)), ((1, 0), (a + 1, b), (a + 1, b + 1)), ((0, 1), (a + 1, b + 1), (a, b + 1)), ((-1, 0), (a, b + 1), (a, b)),
        ):
            if (a + dx, b + dy) not in cells:
                sides.setdefault(start, []).append(end)
    best: list[tuple[int, int]] = []
    for start in sorted(sides):
        while sides.get(start):
            way, here = [start], sides[start].pop(0)
            while here != start:
                way.append(here)
                here = sides[here].pop(0)
            if len(way) > len(best):
                best = way
    return best


# --- searches on an extracted subgraph -----------------------------------------------------------


def shortest(adjacency: dict, source, budget: float = math.inf, target=None) -> tuple[dict, dict]:
    """Seconds and predecessors from a source, up to a budget or a target."""
    best, before, todo, done = {source: 0.0}, {}, [(0.0, source)], set()
    while todo:
        d, u = heapq.heappop(todo)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, w in adjacency.get(u, ()):
            if d + w <= budget and d + w < best.get(v, math.inf):
                best[v], before[v] = d + w, u
                heapq.heappush(todo, (d + w, v))
    return {u: best[u] for u in done}, before


def adjacency_of(rows) -> dict:
    out: dict = {}
    for src, dst, seconds in rows:
        out.setdefault(src, []).append((dst, seconds))
    return out


def path_to(before: dict, target) -> list:
    out = [target]
    while out[-1] in before:
        out.append(before[out[-1]])
    return out[::-1]


def one_to_many(directed: DataFrame, pairs: DataFrame, budget: float = math.inf, max_edges: int = SMALL_GRAPH) -> DataFrame:
    """origin, destination, seconds (null if unroutable) of pairs."""
    origins = pairs.select("origin", F.col("origin").alias("node")).distinct()
    found = reachable(directed, origins, budget, max_edges).withColumnRenamed("node", "destination")
    return pairs.join(found, ["origin", "destination"], "left").select("origin", "destination", "seconds")


def best_tour(cost: list[list[float]], round_trip: bool) -> tuple[float, tuple[int, ...]]:
    """Held-Karp over 2 to 10 stops from stop 0; ties within 1e-6 go to the lexicographically least order."""
    n = len(cost)
    table = {(1, 0): (0.0, (0,))}
    for size in range(2, n + 1):
        for rest in itertools.combinations(range(1, n), size - 1):
            mask = 1 | sum(1 << i for i in rest)
            for last in rest:
                options = [
                    (table[mask ^ (1 << last), p][0] + cost[p][last], (*table[mask ^ (1 << last), p][1], last))
                    for p in (0, *rest)
                    if p != last and (mask ^ (1 << last), p) in table
                ]
                if options:
                    least = min(o[0] for o in options)
                    table[mask, last] = min((o for o in options if o[0] <= least + 1e-6), key=lambda o: o[1])
    full = (1 << n) - 1
    ends = [
        (c + (cost[last][0] if round_trip else 0.0), order) for (mask, last), (c, order) in table.items() if mask == full
    ]
    least = min(e[0] for e in ends)
    return min((e for e in ends if e[0] <= least + 1e-6), key=lambda e: e[1])


def optimise(directed: DataFrame, stops: DataFrame, mode: str, round_trip: bool = True) -> DataFrame:
    """tour, seconds, estimated: the best order of two to ten stops (id is a node, lat, lon), from the least id on.

    A leg that the graph does not join is taken as 1.4 times the straight line at the mode's speed, and counted in ``estimated``.
    """
    speed = {"walk": WALK, "cycle": CYCLE}.get(mode, DRIVE_DEFAULT)
    there = stops.select(F.col("id").alias("destination"), F.col("lat").alias("_a"), F.col("lon").alias("_b"))
    # At most ten stops each way.
    pairs = stops.select(F.col("id").alias("origin"), "lat", "lon").crossJoin(F.broadcast(there)).filter("origin <> destination")
    guess = DETOUR * haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b")) / speed
    legs = pairs.join(one_to_many(directed, pairs.select("origin", "destination")), ["origin", "destination"]).select(
        F.lit(1).alias("trip"), "origin", "destination", F.coalesce("seconds", guess).alias("s"), F.col("seconds").isNull().alias("guessed")
    )

    def tour(group: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(group["origin"]))
        cost = {(a, b): s for a, b, s in zip(group["origin"], group["destination"], group["s"])}
        guessed = {(a, b) for a, b, g in zip(group["origin"], group["destination"], group["guessed"]) if g}
        total, order = best_tour([[0.0 if a == b else cost[a, b] for b in ids] for a in ids], round_trip)
        way = [ids[k] for k in order]
        used = list(zip(way, [*way[1:], way[0]] if round_trip else way[1:]))
        return pd.DataFrame({"tour": [",".join(map(str, way))], "seconds": [total], "estimated": [sum(leg in guessed for leg in used)]})

    return legs.groupBy("trip").applyInPandas(tour, "tour string, seconds double, estimated long")


def corridor(places: DataFrame, line: Column, metres: float, k: int | None = None) -> DataFrame:
    """id, offset, along, detour = 2 x offset of places within a distance of a polyline, in travel order; k evenly spread rows at most."""
    legs = F.posexplode(segments_of(line)).alias("leg", "s")
    spark = places.sparkSession
    parts = spark.range(1).select(legs).select(
        "leg", F.array(F.col("s.a"), F.col("s.b")).alias("piece"), haversine(F.col("s.a.y"), F.col("s.a.x"), F.col("s.b.y"), F.col("s.b.x")).alias("m")
    )
    # The legs of the one stated route, numbered and summed in order.
    order = Window.orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("m").over(order), F.lit(0.0)))
    reach = metres / METRES_PER_DEGREE * 1.5
    xs, ys = F.transform("piece", lambda v: v["x"]), F.transform("piece", lambda v: v["y"])
    boxed = places.join(
        F.broadcast(parts),
        F.col("lon").between(F.array_min(xs) - reach, F.array_max(xs) + reach) & F.col("lat").between(F.array_min(ys) - reach, F.array_max(ys) + reach),
    )
    offset = distance_to_line(F.col("piece"), F.col("lat"), F.col("lon"))
    along = F.col("start") + closest_point(F.col("piece"), F.col("lat"), F.col("lon"))["t"] * F.col("m")
    found = boxed.select("id", offset.alias("offset"), along.alias("along")).filter(F.col("offset") <= metres)
    best = found.groupBy("id").agg(F.min(F.struct("offset", "along")).alias("b")).select("id", "b.offset", "b.along")
    best = best.withColumn("detour", 2 * F.col("offset"))
    if k is None:
        return best
    return even_sample(best, k, ["along", "detour", "id"])


def even_sample(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """k rows of a ranked list with both ends, evenly spread; the rows are numbered in sorted ranges, not in one task."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(df, order, "_i").withColumn("_i", F.col("_i") - 1).crossJoin(F.broadcast(n))  # one row of totals
    if k < 2:
        return ranked.filter("_i = 0").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (k - 1) + 0.5).cast("long"))
    return ranked.filter((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def meeting_seed(origins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """lat, lon of a fair place for origins (lat, lon, metres per second): from their mean, ever shorter steps towards whoever is worst off."""
    lat = sum(o[0] for o in origins) / len(origins)
    turn = [sum(f(math.radians(o[1])) for o in origins) for f in (math.sin, math.cos)]
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    lon = wrap(math.degrees(math.atan2(*turn)) if any(turn) else sum(o[1] for o in origins) / len(origins))

    def seconds(o):
        a = math.sin(math.radians(o[0] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(o[0])) * math.sin(math.radians(o[1] - lon) / 2) ** 2
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, a))) / o[2]

    for i in range(SEED_STEPS):
        worst, step = max(origins, key=seconds), 0.5 * 0.85**i
        lat += (worst[0] - lat) * step
        lon = wrap(lon + wrap(worst[1] - lon) * step)
    return lat, lon


def meeting_rank(legs: DataFrame) -> DataFrame:
    """place, worst, spread, total, rank from (place, origin, seconds): places some origin cannot reach fall out; fairest first.

    Legs are summed in their own order, so that equal legs give equal totals however the rows arrive.
    """
    total = F.aggregate(F.array_sort(F.collect_list("seconds")), F.lit(0.0), lambda acc, x: acc + x)
    per = legs.groupBy("place").agg(
        F.max("seconds").alias("worst"),
        (F.max("seconds") - F.min("seconds")).alias("spread"),
        total.alias("total"),
        F.bool_and(F.col("seconds").isNotNull()).alias("ok"),
    )
    return numbered(per.filter("ok").drop("ok"), ["worst", "spread", "total", "place"], "rank").withColumn("rank", F.col("rank").cast("int"))


def boundary_edges(nodes: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Occupied cells (gx, gy) of nodes (lat, lon), and their edges (gx, gy, side) towards empty cells."""
    at = lambda c, scale: F.floor(F.col(c) * F.lit(scale / metres)).cast("long")
    cells = nodes.select(at("lon", METRES_PER_DEGREE).alias("gx"), at("lat", METRES_PER_DEGREE).alias("gy")).distinct()
    sides = F.array(
        *(F.struct(F.lit(n).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in (("e", 1, 0), ("n", 0, 1), ("s", 0, -1), ("w", -1, 0)))
    )
    asked = cells.select("gx", "gy", F.explode(sides).alias("s")).select(
        "gx", "gy", "s.side", (F.col("gx") + F.col("s.dx")).alias("nx"), (F.col("gy") + F.col("s.dy")).alias("ny")
    )
    taken = cells.select(F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    return cells, asked.join(taken, ["nx", "ny"], "left_anti").select("gx", "gy", "side")


class GraphCache:
    """Street graphs kept for reuse: a box inside one that was built for the same mode is answered from it.

    A new graph is built over a box wider by ``margin``; beyond ``most`` graphs the one used longest ago goes.  Graphs are persisted on disk as
    well as in memory, and Spark builds lost parts again.
    """

    def __init__(self, most: int = 4, margin: float = 1.3):
        self.most, self.margin, self.kept = most, margin, []

    def get(self, box: tuple[float, float, float, float], mode: str, build) -> DataFrame:
        """The graph for a box; ``build(box, mode)`` makes a new one."""
        for entry in self.kept:
            (xmin, ymin, xmax, ymax), of_mode, found = entry
            if of_mode == mode and xmin <= box[0] and ymin <= box[1] and xmax >= box[2] and ymax >= box[3]:
                self.kept.remove(entry)
                self.kept.append(entry)
                return found
        dx, dy = ((box[i + 2] - box[i]) * (self.margin - 1) / 2 for i in (0, 1))
        wide = (box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy)
        found = build(wide, mode).persist()
        self.kept.append((wide, mode, found))
        while len(self.kept) > self.most:
            self.kept.pop(0)[2].unpersist()
        return found
