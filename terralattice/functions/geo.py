"""Great-circle and bounding-box expressions.  Distances are metres, coordinates degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
EARTH_RADIUS = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
METRES_PER_DEGREE_GRID = 110_540.0
MAX_RADIUS = 500_000.0
CLOSEST_POINT_PADDING = 1.002


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def clamp_radius(metres: float) -> float:
    """A radius in [0, 500 km]; anything that is not finite is 0."""
    return min(MAX_RADIUS, max(0.0, metres)) if math.isfinite(metres) else 0.0


def radius_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax around a point; longitudes may pass 180."""
    dlat = min(90.0, metres / METRES_PER_DEGREE)
    dlon = min(180.0, metres / (METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 1e-6)))
    return lon - dlon, max(-90.0, lat - dlat), lon + dlon, min(90.0, lat + dlat)


def covering_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax that hold every point within a great-circle distance; ``radius_box`` is a little narrower than that."""
    r = metres / EARTH_RADIUS
    dlat = math.degrees(r) * (1 + 1e-9) + 1e-9
    # Around a pole every longitude is near; else the circle's outermost points lie a little polewards of its centre.
    polar = r >= math.pi / 2 - abs(math.radians(lat)) - 1e-9
    dlon = 180.0 if polar else min(180.0, math.degrees(math.asin(math.sin(r) / math.cos(math.radians(lat)))) * (1 + 1e-9) + 1e-9)
    return lon - dlon, max(-90.0, lat - dlat), lon + dlon, min(90.0, lat + dlat)


def split_at_seam(box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """A box that passes the antimeridian as two boxes within range."""
    xmin, ymin, xmax, ymax = box
    if xmax - xmin >= 360:
        return [(-180.0, ymin, 180.0, ymax)]
    if xmin < -180:
        return [(xmin + 360, ymin, 180.0, ymax), (-180.0, ymin, xmax, ymax)]
    if xmax > 180:
        return [(xmin, ymin, 180.0, ymax), (-180.0, ymin, xmax - 360, ymax)]
    return [box]


def box_meets(bbox: str, box: tuple[float, float, float, float]) -> Column:
    """Inclusive intersection on raw struct fields, so that it reaches the scan."""
    out = None
    for xmin, ymin, xmax, ymax in split_at_seam(box):
        one = (
            (F.col(f"{bbox}.xmax") >= xmin)
            & (F.col(f"{bbox}.xmin") <= xmax)
            & (F.col(f"{bbox}.ymax") >= ymin)
            & (F.col(f"{bbox}.ymin") <= ymax)
        )
        out = one if out is None else out | one
    return out


def box_holds(bbox: str, lat: Column, lon: Column) -> Column:
    return (
        (F.col(f"{bbox}.xmin") <= lon)
        & (F.col(f"{bbox}.xmax") >= lon)
        & (F.col(f"{bbox}.ymin") <= lat)
        & (F.col(f"{bbox}.ymax") >= lat)
    )


def point_in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    out = None
    for xmin, ymin, xmax, ymax in split_at_seam(box):
        one = lon.between(xmin, xmax) & lat.between(ymin, ymax)
        out = one if out is None else out | one
    return out


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def unwrap_longitude(lon: Column, origin: Column) -> Column:
    """The turn of ``lon`` that lies within 180 degrees of ``origin``."""
    return origin + wrap_longitude(lon - origin)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, metres: Column) -> tuple[Column, Column]:
    """lat, lon of the point at a heading and distance."""
    a, t, r = F.radians(lat), F.radians(heading), metres / EARTH_RADIUS
    to = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(to))
    return F.degrees(to), wrap_longitude(lon + F.degrees(turn))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    bx, by = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + bx) * (F.cos(a) + bx) + by * by))
    return F.degrees(lat), wrap_longitude(lon1 + F.degrees(F.atan2(by, F.cos(a) + bx)))


def circular_mean(lon: Column) -> Column:
    """Aggregate: the mean longitude on the circle."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(lon))), F.sum(F.cos(F.radians(lon)))))


def band_of(lat: Column, metres: float) -> Column:
    return F.floor(lat / F.lit(metres / METRES_PER_DEGREE)).cast("long")


def _columns_in(band: Column, metres: float) -> Column:
    """Width in degrees of a grid column in a band."""
    return F.lit(metres / METRES_PER_DEGREE) / F.greatest(
        F.cos(F.radians(band * F.lit(metres / METRES_PER_DEGREE))), F.lit(0.01)
    )


def _column_count(step: Column) -> Column:
    return F.ceil(F.lit(360.0) / step).cast("long")


def grid_cell(lat: Column, lon: Column, metres: float) -> Column:
    """The cell of a point in a grid of about ``metres``: an equi-join key for distance joins."""
    band = band_of(lat, metres)
    step = _columns_in(band, metres)
    column = F.pmod(F.floor((lon + 180) / step).cast("long"), _column_count(step))
    return F.struct(band.alias("band"), column.alias("column"))


def covering_cells(lat: Column, lon: Column, reach: float, metres: float) -> Column:
    """All cells that can hold a point within ``reach`` of the given one, over the antimeridian too."""
    dlat = reach / METRES_PER_DEGREE * CLOSEST_POINT_PADDING
    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.9)))), F.lit(0.01))
    bands = F.sequence(band_of(lat - dlat, metres), band_of(lat + dlat, metres))

    def cells(band: Column) -> Column:
        step = _columns_in(band, metres)
        low = F.floor((lon - dlon + 180) / step).cast("long")
        high = F.floor((lon + dlon + 180) / step).cast("long")
        # The last column before the seam is narrower, so one more is needed beyond it.
        low = F.when(low < 0, low - 1).otherwise(low)
        return F.transform(
            F.sequence(low, high), lambda c: F.struct(band.alias("band"), F.pmod(c, _column_count(step)).alias("column"))
        )

    return F.array_distinct(F.flatten(F.transform(bands, cells)))


def clamped(metres: Column) -> Column:
    """A radius in [0, 500 km]; what is not finite is 0."""
    finite = metres.isNotNull() & ~F.isnan(metres) & (F.abs(metres) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(MAX_RADIUS), F.greatest(F.lit(0.0), metres))).otherwise(0.0)


def valid_point(lat: Column, lon: Column) -> Column:
    """Whether both coordinates are there, finite and within range."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def grid_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of a point, in the scale of the reach grid: 110,540 m to a degree of latitude."""
    return (lon - lon0) * (METRES_PER_DEGREE * max(math.cos(math.radians(lat0)), 1e-6)), (lat - lat0) * METRES_PER_DEGREE_GRID
