"""A tile layout for bounding-box scans: files by tile, and manifests of file extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralattice.functions.geo import box_meets, split_at_seam

TILE = 0.25
MAX_TILES = 128


def tile_of(value: Column, size: float = TILE) -> Column:
    return F.floor(value / F.lit(size)).cast("int")


def tiles_for_box(box: tuple[float, float, float, float], size: float = TILE, most: int = MAX_TILES) -> list[tuple[int, int]] | None:
    """Tiles that a box meets, on both sides of the antimeridian; None if they are too many to go by tile."""
    import math

    out = set()
    for xmin, ymin, xmax, ymax in split_at_seam(box):
        columns = range(math.floor(xmin / size), math.floor(min(xmax, 180 - 1e-9) / size) + 1)
        rows = range(math.floor(ymin / size), math.floor(min(ymax, 90 - 1e-9) / size) + 1)
        if len(columns) * len(rows) > most:
            return None
        out |= {(x, y) for x in columns for y in rows}
    return sorted(out) if len(out) <= most else None


def with_tiles(df: DataFrame, size: float = TILE, bbox: str = "bbox") -> DataFrame:
    """A row per tile that its box meets, so a feature over several tiles is repeated."""
    span = lambda low, high: F.sequence(tile_of(F.col(f"{bbox}.{low}"), size), tile_of(F.col(f"{bbox}.{high}"), size))
    return df.withColumn("tile_x", F.explode(span("xmin", "xmax"))).withColumn("tile_y", F.explode(span("ymin", "ymax")))


def write_tiles(df: DataFrame, path: str, size: float = TILE, bbox: str = "bbox") -> None:
    with_tiles(df, size, bbox).repartition("tile_x", "tile_y").write.mode("overwrite").option("compression", "zstd").partitionBy(
        "tile_x", "tile_y"
    ).parquet(path)


def read_tiles(
    spark: SparkSession, path: str, box: tuple[float, float, float, float], size: float = TILE, bbox: str = "bbox", key: str = "id"
) -> DataFrame:
    """Features that meet a box: only its tiles are listed and read, and repeats fall out by id."""
    df, tiles = spark.read.parquet(path), tiles_for_box(box, size)
    if tiles is not None:
        columns, rows = sorted({t[0] for t in tiles}), sorted({t[1] for t in tiles})
        df = df.filter(F.col("tile_x").isin(columns) & F.col("tile_y").isin(rows))
    return df.filter(box_meets(bbox, box)).drop("tile_x", "tile_y").dropDuplicates([key])


def extent_manifest(df: DataFrame, by: list[Column], bbox: str = "bbox") -> DataFrame:
    """Extent of each file or group; a group with a row without a box reaches over the world."""
    known = F.col(f"{bbox}.xmin").isNotNull()
    edge = lambda f, c, world: F.when(F.bool_and(known), f(f"{bbox}.{c}")).otherwise(F.lit(world)).alias(c)
    return df.groupBy(*by).agg(
        edge(F.min, "xmin", -180.0),
        edge(F.min, "ymin", -90.0),
        edge(F.max, "xmax", 180.0),
        edge(F.max, "ymax", 90.0),
        F.count(F.lit(1)).alias("n_rows"),
    )


def files_in_box(manifest: DataFrame, box: tuple[float, float, float, float], file: str = "file") -> list[str] | None:
    """Files whose extent meets the box; None, for a whole scan, if none or all do or the box passes the seam."""
    if len(split_at_seam(box)) > 1:
        return None
    xmin, ymin, xmax, ymax = box
    meets = (F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)
    # Only the names of the files to read come to the driver.
    kept = sorted(r[file] for r in manifest.filter(meets).select(file).distinct().collect())
    return kept if 0 < len(kept) < manifest.select(file).distinct().count() else None


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path, listed through Spark's file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, listed = [], at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(".parquet") and "/_" not in name.removeprefix(path):
            found.append(name)
    return sorted(found)


_FOOTERS = "file string, xmin double, ymin double, xmax double, ymax double, n_rows long"


def footer_manifest(spark: SparkSession, path: str, bbox: str = "bbox") -> DataFrame:
    """file, extent and rows of every file, out of the statistics in Parquet footers; a file that lacks any reaches over the world.

    Only footers are read, in tasks of some files each.
    """

    def read(frames):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for frame in frames:
            rows = []
            for file in frame["file"]:
                system, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if "://" not in file else file)
                with system.open_input_file(name) as opened:
                    meta = pq.ParquetFile(opened).metadata
                found = {c: [] for c in ("xmin", "ymin", "xmax", "ymax")}
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        chunk = meta.row_group(g).column(c)
                        field = chunk.path_in_schema.removeprefix(f"{bbox}.")
                        if chunk.path_in_schema.startswith(f"{bbox}.") and field in found:
                            known = chunk.statistics is not None and chunk.statistics.has_min_max
                            found[field].append((chunk.statistics.min, chunk.statistics.max) if known else None)
                whole = all(v and None not in v for v in found.values())
                low = lambda c, world: min(x[0] for x in found[c]) if whole else world  # noqa: B023, E731
                high = lambda c, world: max(x[1] for x in found[c]) if whole else world  # noqa: B023, E731
                rows.append((file, low("xmin", -180.0), low("ymin", -90.0), high("xmax", 180.0), high("ymax", 90.0), meta.num_rows))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOOTERS.split(", ")])

    files = parquet_files(spark, path)
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files) // 16)).mapInPandas(read, _FOOTERS) if files else spark.createDataFrame([], _FOOTERS)


def pruned_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float], manifest: DataFrame | None = None, bbox: str = "bbox") -> DataFrame:
    """Features that meet a box, out of the files whose extents do; all files where that leaves none or spares none."""
    kept = files_in_box(manifest if manifest is not None else footer_manifest(spark, path, bbox), box)
    df = spark.read.parquet(path) if kept is None else spark.read.option("basePath", path).parquet(*kept)
    return df.filter(box_meets(bbox, box))


def resolve(spark: SparkSession, box: tuple[float, float, float, float], path: str, tiles: str | None = None, manifest: DataFrame | None = None, size: float = TILE, bbox: str = "bbox") -> tuple[str, DataFrame]:
    """How a box is read, and its features: from tiles if there are all it needs, else from the files that a manifest leaves, else from all."""
    if tiles is not None and is_cached(spark, tiles, box, size):
        return "tiles", read_tiles(spark, tiles, box, size, bbox)
    if manifest is not None and files_in_box(manifest, box) is not None:
        return "manifest", pruned_scan(spark, path, box, manifest, bbox)
    return "scan", spark.read.parquet(path).filter(box_meets(bbox, box))


def _tile_folder(spark: SparkSession, path: str, tile: tuple[int, int]):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tile_x={tile[0]}/tile_y={tile[1]}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_cached(spark: SparkSession, path: str, box: tuple[float, float, float, float], size: float = TILE) -> bool:
    """Whether every tile of a box has been written."""
    tiles = tiles_for_box(box, size)
    return tiles is not None and all(system.exists(at) for system, at in (_tile_folder(spark, path, t) for t in tiles))


def prewarm(df: DataFrame, path: str, box: tuple[float, float, float, float], size: float = TILE, bbox: str = "bbox") -> list[tuple[int, int]]:
    """Writes the tiles of a box that are missing, whole, in one pass over the features that meet them; returns them."""
    spark = df.sparkSession
    missing = [t for t in tiles_for_box(box, size) or [] if not (lambda s, at: s.exists(at))(*_tile_folder(spark, path, t))]
    if missing:
        import math

        # At most MAX_TILES tiles; the box is widened to their edges for the scan.
        wanted = spark.createDataFrame(missing, "tile_x int, tile_y int")
        low, high = (lambda v: math.floor(v / size) * size), (lambda v: (math.floor(v / size) + 1) * size)
        wide = (low(box[0]), low(box[1]), high(box[2]), high(box[3]))
        near = with_tiles(df.filter(box_meets(bbox, wide)), size, bbox).join(F.broadcast(wanted), ["tile_x", "tile_y"], "left_semi")
        near.repartition("tile_x", "tile_y").write.mode("append").option("compression", "zstd").partitionBy("tile_x", "tile_y").parquet(path)
        for tile in missing:  # a tile without features is there too
            system, at = _tile_folder(spark, path, tile)
            system.mkdirs(at)
    return missing


def evict(spark: SparkSession, path: str, most_bytes: int, keep: tuple = ()) -> list[str]:
    """Removes the tiles that were written longest ago until the rest fits a size; those in ``keep`` are in use and stay."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = []
    for column in system.listStatus(root):
        if column.isDirectory():
            for tile in system.listStatus(column.getPath()):
                size = system.getContentSummary(tile.getPath()).getLength()
                folders.append((tile.getModificationTime(), tile.getPath().toString(), size, tile.getPath()))
    left, gone = sum(f[2] for f in folders), []
    for _, name, size, at in sorted(folders, key=lambda f: f[:2]):
        if left <= most_bytes:
            break
        if not name.endswith(tuple(f"tile_x={x}/tile_y={y}" for x, y in keep) or ("\0",)):
            system.delete(at, True)
            left -= size
            gone.append(name)
    return gone
