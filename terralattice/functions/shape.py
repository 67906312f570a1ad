"""Geometry without a spatial library: vertex arrays and higher-order functions; pandas only for clip, hull and simplify.

A line or ring is ``array<struct<x,y>>``; a polygon is ``array`` of rings (outer first), open or closed alike.
"""

from __future__ import annotations

import itertools
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.functions.geo import METRES_PER_DEGREE, destination, haversine

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"
_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING_TYPE = T.ArrayType(_VERTEX)
SHAPE_TYPE = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(RING_TYPE)))]
)


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments_of(line: Column) -> Column:
    """Pairs of neighbouring vertices of an open line."""
    n = F.size(line)
    return F.zip_with(
        F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def edges_of(ring: Column) -> Column:
    """Edges of a ring, with the closing one; an edge of length 0 does no harm."""
    return segments_of(F.concat(ring, F.slice(ring, 1, 1)))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _from_first(ring: Column) -> Column:
    """The ring with its first vertex as origin: sums of products then keep their digits for small shapes far from 0."""
    first = F.get(ring, F.lit(0))
    return F.transform(ring, lambda v: vertex(v["x"] - first["x"], v["y"] - first["y"]))


def signed_area(ring: Column) -> Column:
    return _total(edges_of(_from_first(ring)), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(polygon: Column) -> Column:
    """Unsigned planar area of the outer ring without its holes."""
    rings = F.transform(polygon, lambda r: F.abs(signed_area(r)))
    return F.greatest(2 * F.get(rings, F.lit(0)) - _total(rings, lambda a: a), F.lit(0.0))


def area_m2(polygon: Column, lat: Column) -> Column:
    """Square metres at a reference latitude."""
    return area(polygon) * F.lit(METRES_PER_DEGREE * METRES_PER_DEGREE) * F.cos(F.radians(lat))


def ring_crossings(ring: Column, x: Column, y: Column) -> Column:
    """Edges that a ray to the right crosses, half-open in y."""
    return F.size(
        F.filter(
            edges_of(ring),
            lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
        )
    )


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges_of(ring),
        lambda e: (
            (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) == (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        )
        & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"]))
        & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])),
    )


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings; a point on the boundary is outside."""
    crossings = F.aggregate(polygon, F.lit(0), lambda acc, r: acc + ring_crossings(r, x, y))
    return (crossings % 2 == 1) & ~F.exists(polygon, lambda r: on_boundary(r, x, y))


def contains_any(shape: Column, x: Column, y: Column) -> Column:
    """Any part of a multi-polygon."""
    return F.exists(shape, lambda p: contains(p, x, y))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted; the vertices' mean where the area is 0."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    a, n, first = signed_area(ring), F.size(ring), F.get(ring, F.lit(0))
    edges = edges_of(_from_first(ring))
    return F.when(
        a != 0,
        vertex(
            first["x"] + _total(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (6 * a),
            first["y"] + _total(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / (6 * a),
        ),
    ).otherwise(vertex(_total(ring, lambda v: v["x"]) / n, _total(ring, lambda v: v["y"]) / n))


def centroid(polygon: Column) -> Column:
    """Area-weighted centre of a polygon without its holes."""
    parts = F.transform(polygon, lambda r: F.struct(F.abs(signed_area(r)).alias("a"), ring_centroid(r).alias("c")))
    outer = F.get(parts, F.lit(0))
    weigh = lambda axis: 2 * outer["a"] * outer["c"][axis] - _total(parts, lambda p: p["a"] * p["c"][axis])
    whole = 2 * outer["a"] - _total(parts, lambda p: p["a"])
    return F.when(whole > 0, vertex(weigh("x") / whole, weigh("y") / whole)).otherwise(outer["c"])


def dimension(kind: Column) -> Column:
    """0 for points, 1 for lines, 2 for areas."""
    return F.when(kind.isin("point", "multipoint"), 0).when(kind.isin("line", "multiline"), 1).when(kind.isin("polygon", "multipolygon"), 2)


def span(line: Column) -> Column:
    """The longer side of a line's box, in degrees."""
    box = bbox(line)
    return F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])


def nearest_of(points: Column, lat: Column, lon: Column) -> Column:
    """Place in a list of the nearest point; the first of equally near ones."""
    away = F.transform(points, lambda p, i: F.struct(haversine(lat, lon, p["y"], p["x"]).alias("d"), i.alias("i")))
    return F.array_min(away)["i"]


def point_along(line: Column, share: Column) -> Column:
    """The point at a share of a line's length."""
    legs = F.transform(
        segments_of(line), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), haversine(s["a"]["y"], s["a"]["x"], s["b"]["y"], s["b"]["x"]).alias("m"))
    )
    goal = share * _total(legs, lambda x: x["m"])

    def step(acc: Column, leg: Column) -> Column:
        here = (goal >= acc["done"]) & (goal <= acc["done"] + leg["m"]) & acc["p"].isNull()
        t = F.when(leg["m"] > 0, (goal - acc["done"]) / leg["m"]).otherwise(0.0)
        there = vertex(leg["a"]["x"] + t * (leg["b"]["x"] - leg["a"]["x"]), leg["a"]["y"] + t * (leg["b"]["y"] - leg["a"]["y"]))
        return F.struct((acc["done"] + leg["m"]).alias("done"), F.when(here, there).otherwise(acc["p"]).alias("p"))

    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast(_VERTEX).alias("p"))
    return F.coalesce(F.aggregate(legs, start, step)["p"], F.element_at(line, -1))


def fraction_on(line: Column, lat: Column, lon: Column) -> Column:
    """Share of a line's length at which it comes nearest to a point."""
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    legs = segments_of(line)
    metres = F.transform(legs, lambda s: haversine(s["a"]["y"], s["a"]["x"], s["b"]["y"], s["b"]["x"]))
    best = F.array_min(F.transform(legs, lambda s, i: F.struct(_projected(s, lon, lat, scale)["d2"].alias("d2"), i.alias("i"), _projected(s, lon, lat, scale)["t"].alias("t"))))
    before = _total(F.slice(metres, F.lit(1), best["i"]), lambda m: m)
    return (before + best["t"] * F.get(metres, best["i"])) / _total(metres, lambda m: m)


def bbox(line: Column) -> Column:
    xs, ys = F.transform(line, lambda v: v["x"]), F.transform(line, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def length_m(line: Column) -> Column:
    return _total(segments_of(line), lambda s: haversine(s["a"]["y"], s["a"]["x"], s["b"]["y"], s["b"]["x"]))


def _projected(s: Column, x: Column, y: Column, scale: Column) -> Column:
    """Nearest point on one segment, with longitudes shrunk by ``scale``, and its squared planar distance."""
    dx, dy = (s["b"]["x"] - s["a"]["x"]) * scale, s["b"]["y"] - s["a"]["y"]
    square = dx * dx + dy * dy
    t = F.when(
        square > 0,
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - s["a"]["x"]) * scale * dx + (y - s["a"]["y"]) * dy) / square)),
    ).otherwise(F.lit(0.0))
    px, py = s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * dy
    ex, ey = (x - px) * scale, y - py
    return F.struct((ex * ex + ey * ey).alias("d2"), px.alias("x"), py.alias("y"), t.alias("t"))


def closest_point(line: Column, lat: Column, lon: Column) -> Column:
    """struct<d2,x,y,t> of the nearest point on a line; the first segment wins ties."""
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    found = F.transform(segments_of(line), lambda s: _projected(s, lon, lat, scale))
    return F.array_min(found)


def planar_distance(line: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a line in the plane of its coordinates."""
    return F.sqrt(F.array_min(F.transform(segments_of(line), lambda s: _projected(s, x, y, F.lit(1.0))["d2"])))


def distance_to_line(line: Column, lat: Column, lon: Column) -> Column:
    p = closest_point(line, lat, lon)
    return haversine(lat, lon, p["y"], p["x"])


def buffer_ring(lat: Column, lon: Column, metres: Column, sides: int = 32) -> Column:
    def corner(i: Column) -> Column:
        to_lat, to_lon = destination(lat, lon, i * (360.0 / sides), metres)
        return vertex(to_lon, to_lat)

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), corner)


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax))


# --- parsing ---------------------------------------------------------------------------------


def _wkb(data: bytes, at: int = 0):
    """(kind, parts, end): parts are polygons; a line is one part of one ring, a point one vertex."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    step = 2 + (kind // 1000 in (1, 3) or bool(kind & 0x80000000)) + (kind // 1000 in (2, 3) or bool(kind & 0x40000000))
    base = (kind & 0xFFFF) % 1000

    def count(at):
        return struct.unpack_from(f"{order}I", data, at)[0], at + 4

    def run(n, at):
        values = np.frombuffer(data, f"{order}f8", n * step, at).reshape(n, step)[:, :2]
        return [(float(x), float(y)) for x, y in values], at + 8 * n * step

    if base == 1:
        points, at = run(1, at)
        return "point", [[points]], at
    if base == 2:
        n, at = count(at)
        points, at = run(n, at)
        return "line", [[points]], at
    if base == 3:
        n, at = count(at)
        rings = []
        for _ in range(n):
            m, at = count(at)
            points, at = run(m, at)
            rings.append(points)
        return "polygon", [rings], at
    n, at = count(at)
    parts, kind = [], "collection"
    for _ in range(n):
        kind, some, at = _wkb(data, at)
        parts += some
    return kind, parts, at


@F.pandas_udf(SHAPE_TYPE)
def decode_wkb(values: pd.Series) -> pd.DataFrame:
    rows = []
    for data in values:
        kind, parts, _ = _wkb(bytes(data)) if data is not None else (None, None, 0)
        rows.append((kind, parts and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]))
    return pd.DataFrame(rows, columns=["kind", "parts"])


def encode_wkb_polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))), ", "), F.lit(")"))


def geojson_line(line: Column) -> Column:
    """A line as GeoJSON text."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda v: F.array(v["x"], v["y"])).alias("coordinates")))


@F.pandas_udf(T.BinaryType())
def wkb_line(lines: pd.Series) -> pd.Series:
    return lines.map(
        lambda line: None if line is None else struct.pack("<BII", 1, 2, len(line)) + b"".join(struct.pack("<dd", v["x"], v["y"]) for v in line)
    )


def parse_wkt_line(c: Column) -> Column:
    """Vertices of LINESTRING(x y, x y, ...)."""
    body = F.regexp_extract(c, r"\(([^()]*)\)", 1)
    return F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: vertex(F.split(F.trim(p), r"\s+")[0].cast("double"), F.split(F.trim(p), r"\s+")[1].cast("double")),
    )


def parse_geojson_line(c: Column) -> Column:
    parsed = F.from_json(c, "type string, coordinates array<array<double>>")
    return F.transform(parsed["coordinates"], lambda p: vertex(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


# --- pandas-backed operators --------------------------------------------------------------------


def hull_of(points) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the lowest x; empty if the points are on one line.

    The two chains are found by splitting: the point farthest to the right of a line is a corner, and what lies beyond its two sides goes on.
    """
    p = np.unique(np.array(list(points), float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return []
    out, todo = [], [(p[0], p[-1], p), (p[-1], p[0], p)]
    while todo:
        a, b, some = todo.pop(0)
        off = (b[0] - a[0]) * (some[:, 1] - a[1]) - (b[1] - a[1]) * (some[:, 0] - a[0])
        beyond, off = some[off < 0], off[off < 0]
        if not len(beyond):
            out.append(a)
            continue
        # Of equally far points the one nearest to the start is a corner for sure.
        far = beyond[np.lexsort((((beyond - a) ** 2).sum(1), off))[0]]
        todo = [(a, far, beyond), (far, b, beyond), *todo]
    return [(float(x), float(y)) for x, y in out] if len(out) > 2 else []


def _corners(df, key: str, x: str, y: str):
    """key, hull: of each task's points of a key the corners of their hull, or the ends if they are on one line."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, hull {RING}"

    def own(frames):
        found: dict = {}
        for frame in frames:
            for value, part in frame.groupby(key, dropna=False):
                points = [*found.get(value, []), *zip(part[x], part[y])]
                found[value] = hull_of(points) or sorted(set(points))[:: max(1, len(set(points)) - 1)]
        yield pd.DataFrame([(v, [{"x": a, "y": b} for a, b in ring]) for v, ring in found.items()], columns=[key, "hull"])

    return df.select(key, x, y).dropna(subset=[x, y]).mapInPandas(own, schema)


def hulls(df, key: str, x: str, y: str):
    """key, hull of each key's points.  Tasks send the corners of their own points' hulls; the hull of these is the whole one."""
    return _corners(df, key, x, y).groupBy(key).agg(convex_hull(F.flatten(F.collect_list("hull"))).alias("hull"))


def circles(df, key: str, x: str, y: str):
    """key, circle (x, y, r) around each key's points: the circle around the corners of the tasks' hulls."""
    return _corners(df, key, x, y).groupBy(key).agg(enclosing(F.flatten(F.collect_list("hull"))).alias("circle"))


@F.pandas_udf(RING_TYPE)
def convex_hull(values: pd.Series) -> pd.Series:
    return values.map(
        lambda line: [] if line is None else [{"x": x, "y": y} for x, y in hull_of((v["x"], v["y"]) for v in line)]
    )


def _intervals(rings, y: float) -> list[tuple[float, float]]:
    xs = []
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y):
                xs.append(ax + (y - ay) * (bx - ax) / (by - ay))
    xs.sort()
    return list(zip(xs[::2], xs[1::2]))


def overlap_area_of(a, b) -> float:
    """Area common to two polygons (lists of rings): exact slabs between all vertices and crossings."""
    heights = {y for rings in (a, b) for ring in rings for _, y in ring}
    edges = [[(p, q) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]])] for rings in (a, b)]
    for (ax, ay), (bx, by) in edges[0]:
        for (cx, cy), (dx, dy) in edges[1]:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                if 0 <= t <= 1:
                    heights.add(ay + t * (by - ay))
    levels, total = sorted(heights), 0.0
    for low, high in zip(levels, levels[1:]):
        # Between two levels no edges cross, so widths are linear and two inner heights give the slab exactly.
        widths = []
        for y in (low + (high - low) / 4, high - (high - low) / 4):
            widths.append(
                sum(
                    max(0.0, min(r1, r2) - max(l1, l2))
                    for l1, r1 in _intervals(a, y)
                    for l2, r2 in _intervals(b, y)
                )
            )
        total += (widths[0] + widths[1]) / 2 * (high - low)
    return total


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    rings = lambda p: [[(v["x"], v["y"]) for v in r] for r in p]
    return pd.Series([None if x is None or y is None else overlap_area_of(rings(x), rings(y)) for x, y in zip(a, b)], dtype="float64")


def simplify_line(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker with an explicit stack; the tolerance is in the points' unit."""
    if len(points) < 3:
        return points
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    p = np.array(points, float)
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, inner = p[b] - p[a], p[a + 1 : b] - p[a]
        square = float(d @ d)
        t = np.clip(inner @ d / square, 0, 1) if square else np.zeros(len(inner))
        off = np.hypot(*(inner - t[:, None] * d).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return [points[i] for i in sorted(keep)]


def _significance(x: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every vertex of many lines the largest tolerance below which Douglas-Peucker keeps it; ends are kept always.

    A stretch splits at the same vertex whatever the tolerance, so all stretches of a level are split at once.
    """
    worth = np.zeros(len(x))
    some = size > 0
    worth[first[some]] = worth[(first + size - 1)[some]] = np.inf
    a, b = first[size > 2], (first + size - 1)[size > 2]
    cap = np.full(len(a), np.inf)
    while len(a):
        inner = b - a - 1
        begin = np.cumsum(inner) - inner
        part = np.repeat(np.arange(len(a)), inner)
        at = np.arange(len(part)) - begin[part] + a[part] + 1
        dx, dy = (x[b] - x[a])[part], (y[b] - y[a])[part]
        px, py = x[at] - x[a][part], y[at] - y[a][part]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / np.where(square > 0, square, 1.0), 0, 1)
        off = np.hypot(px - t * dx, py - t * dy)
        most = np.maximum.reduceat(off, begin)
        hit = np.flatnonzero((off == most[part]) & (off > 0))
        owner, where = np.unique(part[hit], return_index=True)
        far, cap = at[hit[where]], np.minimum(cap[owner], most[owner])
        worth[far] = cap
        a, b, cap = np.concatenate([a[owner], far]), np.concatenate([far, b[owner]]), np.concatenate([cap, cap])
        open_ = b - a > 1
        a, b, cap = a[open_], b[open_], cap[open_]
    return worth


def _finest(worth: np.ndarray, first: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each line the least tolerance that leaves at most ``most`` vertices; -1 where all may stay, or there are only ends."""
    line = np.repeat(np.arange(len(size)), size)
    ranked = worth[np.lexsort((-worth, line))]
    tolerance = np.full(len(size), -1.0)
    cut = (size > most) & (size > 2)
    tolerance[cut] = ranked[(first + np.maximum(most, 2))[cut]]
    return tolerance


def simplify_to_count(points: list[tuple[float, float]], most: int) -> tuple[list[tuple[float, float]], float]:
    """The finest simplification with at most ``most`` vertices (its ends at least), and its tolerance."""
    p, first, size = np.array(points, float).reshape(-1, 2), np.array([0]), np.array([len(points)])
    worth = _significance(p[:, 0], p[:, 1], first, size)
    tolerance = float(_finest(worth, first, size, np.array([most]))[0])
    return [v for v, w in zip(points, worth) if w > tolerance], max(tolerance, 0.0)


def simplified_within(tolerance: float):
    """A line without the vertices that lie within a tolerance of it, in the unit of its coordinates."""

    @F.pandas_udf(RING_TYPE)
    def run(values: pd.Series) -> pd.Series:
        return values.map(
            lambda line: None if line is None else [{"x": x, "y": y} for x, y in simplify_line([(v["x"], v["y"]) for v in line], tolerance)]
        )

    return run


@F.arrow_udf(RING_TYPE)
def _simplified(lines: pa.Array, most: pa.Array) -> pa.Array:
    flat, size = lines.flatten(), lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    worth = _significance(x, y, first, size)
    tolerance = _finest(worth, first, size, most.to_numpy(zero_copy_only=False).astype(np.int64))
    keep = worth > np.repeat(tolerance, size)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    none = pa.array(lines.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)), mask=none)


def simplified(most: int | Column):
    """A line's finest simplification with at most so many vertices; whole batches of lines are split together."""
    return lambda line: _simplified(line, (most if isinstance(most, Column) else F.lit(most)).cast("long"))


def _around_few(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Radius, centre and defining points of the smallest circle around up to four points: the best centre of a pair or triple."""
    best = None
    for k in (2, 3):
        for some in map(list, itertools.combinations(range(len(p)), k)):
            a = p[some[0]]
            if k == 2:
                centre = a + (p[some[1]] - a) / 2
            else:
                (bx, by), (cx, cy) = p[some[1]] - a, p[some[2]] - a
                d = 2 * (bx * cy - by * cx)
                if not d:
                    continue
                b2, c2 = bx * bx + by * by, cx * cx + cy * cy
                centre = a + np.array([(b2 * cy - c2 * by) / d, (c2 * bx - b2 * cx) / d])
            r = float(np.hypot(*(p - centre).T).max())
            if best is None or r < best[0]:
                best = (r, centre, p[some])
    return best


def enclosing_circle(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    """x, y, radius of the smallest circle around points.

    Only corners of the hull count.  The circle around a few of them takes in the farthest one outside, which makes it larger, until none is outside.
    """
    points = sorted(set(points))
    p = np.array(hull_of(points) or [points[0], points[-1]], float)
    if len(points) == 1:
        return (*points[0], 0.0)
    r, centre, few = _around_few(p[[0, -1]])
    while True:
        away = np.hypot(*(p - centre).T)
        far = int(away.argmax())
        if away[far] <= r * (1 + 1e-12):
            break
        wider = _around_few(np.vstack([few, p[far]]))
        if wider[0] <= r:
            break  # only rounding is left outside
        r, centre, few = wider
    return float(centre[0]), float(centre[1]), max(r, float(away[far]))


_CIRCLE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "r")])


@F.pandas_udf(_CIRCLE)
def enclosing(values: pd.Series) -> pd.DataFrame:
    """x, y, r of the smallest circle around each list of points; null around none."""
    none = (None, None, None)
    found = [none if points is None or not len(points) else enclosing_circle([(v["x"], v["y"]) for v in points]) for points in values]
    return pd.DataFrame(found, columns=["x", "y", "r"], dtype="float64")
