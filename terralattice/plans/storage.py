"""Queries on how data lies: files, tiles, manifests, releases, name tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions.geo import box_meets
from terralattice.operators import answers as W
from terralattice.operators import names as N
from terralattice.plans import geography as G
from terralattice.plans._register import PLACES_SQL, query
from terralattice.plans.names import _ALTS, _FOLD, _NAMES, _divisions
from terralattice.sources import catalog as C
from terralattice.sources import tiles as S
from terralattice.sources.scratch import new_path

_TILE = "CAST(floor(lon / 625e-4) AS INTEGER) AS tile_x, CAST(floor(lat / 625e-4) AS INTEGER) AS tile_y"
_BOX = (-73.95, 40.65, -73.90, 40.70)
_IN_BOX = "lon BETWEEN -7395e-2 AND -7390e-2 AND lat BETWEEN 4065e-2 AND 4070e-2"


def _boxed(spark, sf_dir):
    return G.with_bbox(G.places(spark, sf_dir).select("id", "name", "lat", "lon"))


def _stored(spark, sf_dir):
    """The places' path, once they are written as files of neighbours."""
    path = new_path(spark, "places")
    _boxed(spark, sf_dir).repartitionByRange(16, "bbox.xmin").write.parquet(path)
    return path


def _tiled(spark, sf_dir):
    path = new_path(spark, "tiles")
    S.write_tiles(_boxed(spark, sf_dir), path, 0.0625)
    return path


@query("s01_partitioned_scan", f"WITH {PLACES_SQL} SELECT {_TILE}, count(*) AS n FROM places GROUP BY 1, 2")
def s01_partitioned_scan(spark, sf_dir):
    """Partition columns that only the folders' names hold."""
    return spark.read.parquet(_tiled(spark, sf_dir)).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


@query("s02_file_list_scan", f"WITH {PLACES_SQL} SELECT id, name, CAST(NULL AS VARCHAR) AS operating_status FROM places")
def s02_file_list_scan(spark, sf_dir):
    places = C.Dataset("places", "place", {"id": "long", "name": "string", "operating_status": "string"})
    found = C.Catalog(spark, "none", "2024-01-01.0").read(places, S.parquet_files(spark, _stored(spark, sf_dir)))
    return found.select("id", "name", "operating_status")


@query("s03_manifest_pruned_scan", f"WITH {PLACES_SQL} SELECT id FROM places WHERE {_IN_BOX}")
def s03_manifest_pruned_scan(spark, sf_dir):
    """Footers tell which files meet the box; only those are read."""
    return S.pruned_scan(spark, _stored(spark, sf_dir), _BOX).select("id")


@query("s04_footer_manifest", f"WITH {PLACES_SQL} SELECT round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax, count(*) AS n_rows FROM places")
def s04_footer_manifest(spark, sf_dir):
    found = S.footer_manifest(spark, _stored(spark, sf_dir))
    low, high = lambda c: F.round(F.min(c), 6).alias(c), lambda c: F.round(F.max(c), 6).alias(c)
    return found.agg(low("xmin"), low("ymin"), high("xmax"), high("ymax"), F.sum("n_rows").alias("n_rows"))


@query("s04_extent_manifest", f"WITH {PLACES_SQL} SELECT {_TILE}, round(min(lon), 6) AS xmin, round(max(lat), 6) AS ymax, count(*) AS n_rows FROM places GROUP BY 1, 2")
def s04_extent_manifest(spark, sf_dir):
    df = S.with_tiles(G.with_bbox(G.places(spark, sf_dir)), 0.0625)
    found = S.extent_manifest(df, [F.col("tile_x"), F.col("tile_y")])
    return found.select("tile_x", "tile_y", F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"), "n_rows")


@query("s07_resolved_scan", f"WITH {PLACES_SQL} SELECT id, way FROM places, (VALUES ('tiles'), ('manifest'), ('scan')) v(way) WHERE {_IN_BOX}")
def s07_resolved_scan(spark, sf_dir):
    """The same features by tiles, by a manifest's files, and by a whole scan."""
    path, tiles = _stored(spark, sf_dir), _tiled(spark, sf_dir)
    manifest = S.footer_manifest(spark, path)
    ways = [S.resolve(spark, _BOX, path, tiles, manifest, 0.0625), S.resolve(spark, _BOX, path, None, manifest), S.resolve(spark, _BOX, path)]
    out = None
    for way, df in ways:
        part = df.select("id", F.lit(way).alias("way"))
        out = part if out is None else out.unionAll(part)
    return out


@query("s08_tile_enumerate", f"WITH {PLACES_SQL} SELECT id, {_TILE} FROM places")
def s08_tile_enumerate(spark, sf_dir):
    return S.with_tiles(G.with_bbox(G.places(spark, sf_dir)), 0.0625).select("id", "tile_x", "tile_y")


@query("s09_tile_write_read", f"WITH {PLACES_SQL} SELECT id, name FROM places WHERE {_IN_BOX}")
def s09_tile_write_read(spark, sf_dir):
    return S.read_tiles(spark, _tiled(spark, sf_dir), _BOX, 0.0625).select("id", "name")


@query("s12_prewarmed_scan", f"WITH {PLACES_SQL} SELECT id FROM places WHERE {_IN_BOX}")
def s12_prewarmed_scan(spark, sf_dir):
    """A box whose tiles are written ahead, and then read."""
    path = new_path(spark, "warm")
    S.prewarm(_boxed(spark, sf_dir), path, _BOX, 0.0625)
    return S.read_tiles(spark, path, _BOX, 0.0625).select("id")


@query("s05_probed_schema", "SELECT 'bbox,id,lat,lon,name' AS columns, true AS missing_is_none")
def s05_probed_schema(spark, sf_dir):
    """Columns from footers alone; a dataset that is not there is remembered as such."""
    path = _stored(spark, sf_dir)
    catalog = C.Catalog(spark, "file:///nowhere", "2024-01-01.0", {("2024-01-01.0", "place"): path})
    found = catalog.probe(C.PLACES)
    gone = catalog.probe(C.BUILDINGS) is None and catalog.probe(C.BUILDINGS) is None and len(catalog.failed) == 1
    return spark.range(1).select(F.lit(",".join(sorted(found.fieldNames()))).alias("columns"), F.lit(gone).alias("missing_is_none"))


@query("s13_name_table", f"WITH {_NAMES} SELECT id, {_FOLD.format('name')} AS folded, population FROM divisions")
def s13_name_table(spark, sf_dir):
    path = new_path(spark, "names")
    N.write_name_table(_divisions(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "folded", "population")


@query("s14_alternate_table", f"WITH {_ALTS} SELECT id, folded, alt FROM alts")
def s14_alternate_table(spark, sf_dir):
    path = new_path(spark, "alternates")
    N.write_alternates(_divisions(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "folded", "alt")


@query("s15_name_index", f"WITH {_ALTS}, top AS (SELECT id FROM divisions WHERE population > 0 ORDER BY population DESC, id LIMIT 7) SELECT id, folded, alt FROM alts WHERE id IN (SELECT id FROM top)")
def s15_name_index(spark, sf_dir):
    d = _divisions(spark, sf_dir)
    return N.name_index(d, N.alternate_names(d), 7)[1].select("id", "folded", "alt")


@query("s17_mirror", f"WITH {PLACES_SQL} SELECT count(*) AS n, sum(id) AS ids FROM places")
def s17_mirror(spark, sf_dir):
    path = new_path(spark, "mirror")
    n = C.mirror(_boxed(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("n"), F.sum("id").alias("ids"))


@query("f03_pushed_box", f"WITH {PLACES_SQL} SELECT id FROM places WHERE {_IN_BOX}")
def f03_pushed_box(spark, sf_dir):
    """A box on raw struct fields, which reaches the scan of the stored files."""
    return spark.read.parquet(_stored(spark, sf_dir)).filter(box_meets("bbox", _BOX)).select("id")


@query(
    "s25_text_features",
    f"""WITH {PLACES_SQL} SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lon, 6) || ',' || round(lat, 6) || ']}},"properties":{{"id":' || id || ',"name":"' || name || '"}}}}' AS feature,
    printf('<wpt lat="%.6f" lon="%.6f"><name>%s</name></wpt>', lat, lon, name) AS gpx, printf('geo:%.6f,%.6f?z=17', lat, lon) AS link FROM places""",
)
def s25_text_features(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return G.places(spark, sf_dir).select(
        "id", W.feature(["id", "name"], lat, lon).alias("feature"), W.track_point(lat, lon, F.col("name")).alias("gpx"), W.map_link(lat, lon).alias("link")
    )


@query("s10_tiles_after_eviction", f"WITH {PLACES_SQL} SELECT id FROM places WHERE {_IN_BOX}")
def s10_tiles_after_eviction(spark, sf_dir):
    """A box read when the cache has lost its tiles again: the source answers."""
    path, cache = _stored(spark, sf_dir), _tiled(spark, sf_dir)
    S.evict(spark, cache, 0)
    return S.resolve(spark, _BOX, path, cache, None, 0.0625)[1].select("id")
