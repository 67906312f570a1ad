"""Queries and operators over whole tables, against brute force."""

import glob
import os

import duckdb
import pyarrow.parquet as pq
import pytest

from terralattice import registry
from terralattice.functions import text
from terralattice.operators import graph
from terralattice.operators import names as names_operators
from terralattice.plans import geography

DATA = "/root/testdata/sf0.001"


def column(name, key):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=[key])[key].to_pylist()


def views(c):
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    return str(v.tolist()) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "item") else v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


def brute_components(pairs):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(least)}


def test_components_of_all_edges(spark):
    edges = [(r["src"], r["dst"]) for r in geography.road_edges(spark, DATA).select("src", "dst").collect()]
    got = {r["node"]: r["component"] for r in registry.QUERIES["n04_components"](spark, DATA).collect()}
    assert got == brute_components(edges) and max(got) >= 60


def test_snap_to_nodes_of_all_edges(spark, tmp_path):
    # Supplier 301 lies on node 301, which only edges beyond the first 300 ids reach.
    line = [(1, n, n + 1 - 301, 1) for n in range(301, 308)]
    spark.createDataFrame(
        [(o, p, p, i, 5.0, 1.0, "A", "F") for o, p, i, _ in line],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(301, "s", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["n03_snap"](spark, str(tmp_path)).collect()
    assert [(r["id"], r["node"], r["distance"]) for r in got] == [(301, 301, 0.0)]


@pytest.fixture(scope="module")
def db():
    return views(duckdb.connect())


@pytest.mark.parametrize(
    "name", ["g08_line_length", "g14_simplify_line", "w10_polyline_arc_length", "g04_nearest_on_lines", "w03_in_range_count", "f21_generalised_water"]
)
def test_lines_of_all_orders(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        assert set(got["id"]) == set(column("orders", "o_orderkey"))
        return
    want = registry.ORACLES[name]
    assert "% 10 = 0" not in want and rows(got) == rows(db.execute(want).df())


def test_reachable_has_no_limit_of_edges(spark):
    # A straight way of 9 s, and 20 edges that take 2 s in all.
    edges = [(0, 20, 9.0)] + [(i, i + 1, 0.1) for i in range(20)]
    directed = spark.createDataFrame(edges, "src long, dst long, seconds double")
    start = spark.range(1).selectExpr("id AS origin", "id AS node")
    got = {r["node"]: round(r["seconds"], 6) for r in graph.reachable(directed, start, 10.0).collect()}
    assert got == {i: round(i / 10, 6) for i in range(21)}
    pairs = spark.createDataFrame([(0, 0), (0, 20), (20, 0)], "origin long, destination long")
    got = {(r[0], r[1]): r[2] and round(r[2], 6) for r in graph.one_to_many(directed, pairs, max_edges=5).collect()}
    assert got == {(0, 0): 0.0, (0, 20): 2.0, (20, 0): None}


def test_reachable_within_matches_dijkstra(spark):
    directed = registry.QUERIES["n02_edge_costs"](spark, DATA).collect()
    best, _ = graph.shortest(graph.adjacency_of(directed), 7, 6.0)
    got = {r["node"]: r["seconds"] for r in registry.QUERIES["n05_reachable_within"](spark, DATA).collect()}
    assert got.keys() == best.keys() and all(abs(got[n] - best[n]) < 1e-5 for n in best)


def test_fuzzy_finds_names_with_other_ends(spark):
    name, query = "abcdefghijklmnopq", "xbcdefghijklmnopz"
    names = spark.createDataFrame([(name,), ("other",)], "name string")
    asked = spark.createDataFrame([(query,)], "query string")
    got = names_operators.fuzzy(names, asked, 0.92 - 1e-9).collect()
    assert [(r["query"], r["name"]) for r in got] == [(query, name)]


def test_tiers_of_short_queries(spark):
    names = spark.createDataFrame([(1, "東京都", 5), (2, "Plain 4", 3), (3, "大東京", 1)], "id long, name string, population long")
    asked = spark.createDataFrame([("東京",), ("4",), ("lai",)], "query string")
    got = {(r["query"], r["id"], r["tier"]) for r in names_operators.tiered(names, asked).collect()}
    assert got == {("東京", 1, 2), ("東京", 3, 1), ("4", 2, 1), ("lai", 2, 1)}


def test_streets_of_all_customers_take_the_product(spark):
    got = {r["id"]: r["spellings"] for r in registry.QUERIES["e09_street_variants"](spark, DATA).collect()}
    assert set(got) == set(column("customer", "c_custkey"))
    asked = spark.createDataFrame([("Fifth Main Street",), ("North Oak Lane",), ("5th",)], "t string")
    found = {r["t"]: set(r["v"]) for r in asked.select("t", text.street_variants(asked["t"]).alias("v")).collect()}
    assert found["Fifth Main Street"] == {f"{a} Main {b}" for a in ("Fifth", "5th", "5") for b in ("Street", "St")}
    assert found["North Oak Lane"] == {f"{a} Oak {b}" for a in ("North", "N.", "N") for b in ("Lane", "Ln")}
    assert found["5th"] == {"5th"}
