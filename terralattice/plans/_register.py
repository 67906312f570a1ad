"""The table of named queries, and pieces of SQL that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Centre of the test geography.
LAT, LON = 40.7, -73.9


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sql_lat(key: str) -> str:
    return f"(40.5e0 + CAST(({key} * 7919) % 10007 AS DOUBLE) / 25000e0)"


def sql_lon(key: str) -> str:
    return f"(-74.1e0 + CAST(({key} * 104729) % 10007 AS DOUBLE) / 25000e0)"


def sql_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians(({lat2}) - ({lat1})) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians(({lon2}) - ({lon1})) / 2e0), 2)"
    )
    return f"(12742000e0 * asin(sqrt(least({a}, 1e0))))"


HERE = "40.7e0, -73.9e0"


def sql_from_centre(lat: str = "lat", lon: str = "lon") -> str:
    return sql_distance("40.7e0", "-73.9e0", lat, lon)


PLACES_SQL = f"""
places AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS category, [p_brand] AS alternates, lower(p_type) AS basic_category,
         CAST(p_size % 101 AS DOUBLE) / 100e0 AS confidence,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand,
         CASE WHEN p_partkey % 11 = 0 THEN 'permanently_closed' WHEN p_partkey % 11 = 1 THEN 'temporarily_closed'
              WHEN p_partkey % 11 = 2 THEN NULL ELSE 'open' END AS status,
         CASE WHEN p_partkey % 2 = 0 THEN ['https://' || CAST(p_partkey AS VARCHAR) || '.example'] END AS websites,
         CASE WHEN p_partkey % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN p_partkey % 5 = 1 THEN NULL ELSE ['+1'] END AS phones,
         {sql_lat('p_partkey')} AS lat, {sql_lon('p_partkey')} AS lon
  FROM part
)"""
LAYER_SQL = f"""
layer AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS name,
         CASE s_nationkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END AS category,
         {sql_lat('s_suppkey')} AS lat, {sql_lon('s_suppkey')} AS lon
  FROM supplier
)"""
ADDRESSES_SQL = f"""
addresses AS (
  SELECT c_custkey AS id, CAST(c_custkey % 200 AS VARCHAR) AS number, c_mktsegment || ' ST' AS street,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postcode,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS VARCHAR) END AS unit,
         'NATION_' || CAST(c_nationkey AS VARCHAR) AS postal_city, CASE WHEN c_nationkey < 13 THEN 'US' ELSE 'CA' END AS country,
         {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon
  FROM customer
)"""
CELLS_SQL = """
cells AS (
  SELECT n_nationkey AS id, n_name AS name, n_regionkey AS division_id, 'county' AS subtype,
         -74.1e0 + CAST(n_nationkey % 5 AS DOUBLE) * 8e-2 AS xmin, 40.5e0 + CAST(n_nationkey // 5 AS DOUBLE) * 8e-2 AS ymin,
         -74.1e0 + CAST(n_nationkey % 5 + 1 AS DOUBLE) * 8e-2 AS xmax, 40.5e0 + CAST(n_nationkey // 5 + 1 AS DOUBLE) * 8e-2 AS ymax
  FROM nation
)"""
