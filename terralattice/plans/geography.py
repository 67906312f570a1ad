"""Test geography: deterministic points, polygons, lines and a road graph made from the driver tables' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralattice.functions.shape import rectangle, vertex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_lat(key: Column) -> Column:
    return F.lit(40.5) + ((key * 7919) % 10007).cast("double") / F.lit(25000.0)


def key_lon(key: Column) -> Column:
    return F.lit(-74.1) + ((key * 104729) % 10007).cast("double") / F.lit(25000.0)


def with_point(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lat": key_lat(F.col(key)), "lon": key_lon(F.col(key))})


def with_bbox(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return with_point(table(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.array("p_brand").alias("alternates"),
        F.lower("p_type").alias("basic_category"),
        ((F.col("p_size") % 101).cast("double") / F.lit(100.0)).alias("confidence"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 11 == 0, "permanently_closed").when(k % 11 == 1, "temporarily_closed").when(k % 11 > 2, "open").alias("status"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("https://"), k.cast("string"), F.lit(".example")))).alias("websites"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 > 1, F.array(F.lit("+1"))).alias("phones"),
        "lat",
        "lon",
    )


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey") % 3
    return with_point(table(spark, sf_dir, "supplier"), "s_suppkey").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).alias("name"),
        F.when(nation == 0, "ECONOMY").when(nation == 1, "PROMO").otherwise("LARGE").alias("category"),
        "lat",
        "lon",
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return with_point(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("id"),
        (k % 200).cast("string").alias("number"),
        F.concat("c_mktsegment", F.lit(" ST")).alias("street"),
        F.lpad(n.cast("string"), 5, "0").alias("postcode"),
        F.when(k % 7 != 0, (k % 7).cast("string")).alias("unit"),
        F.concat(F.lit("NATION_"), n.cast("string")).alias("postal_city"),
        F.when(n < 13, "US").otherwise("CA").alias("country"),
        "lat",
        "lon",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division areas: a 5 x 5 grid, one cell per nation; five cells share a region's division id."""
    k = F.col("n_nationkey")
    column, row = (k % 5), F.floor(k / 5)
    at = lambda base, i: F.lit(base) + i.cast("double") * F.lit(0.08)
    out = table(spark, sf_dir, "nation").select(
        k.alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("division_id"),
        F.lit("county").alias("subtype"),
        at(-74.1, column).alias("xmin"),
        at(40.5, row).alias("ymin"),
        at(-74.1, column + 1).alias("xmax"),
        at(40.5, row + 1).alias("ymax"),
    )
    return out.withColumns(
        {
            "bbox": F.struct("xmin", "ymin", "xmax", "ymax"),
            "polygon": F.array(rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))),
        }
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square buildings of suppliers, with a side of 1 to 5 times 0.0001 degrees."""
    half = ((F.col("s_suppkey") % 5) + 1).cast("double") * F.lit(0.00005)
    df = with_point(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("half", half)
    return df.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 3 != 0, F.when(F.col("s_nationkey") % 2 == 0, "residential").otherwise("commercial")).alias("subtype"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 100).alias("height"),
        F.when(F.col("s_suppkey") % 4 == 0, (F.col("s_suppkey") % 9) + 1).alias("num_floors"),
        "lat",
        "lon",
        F.array(rectangle(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half)).alias("polygon"),
    )


def waterways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of three vertices, one per order key."""
    k = F.col("o_orderkey")
    df = with_point(table(spark, sf_dir, "orders"), "o_orderkey")
    bend = ((k % 7) - 3).cast("double") * F.lit(0.001)
    return df.select(
        k.alias("id"),
        F.col("o_orderstatus").alias("subtype"),
        "lat",
        "lon",
        F.array(
            vertex(F.col("lon"), F.col("lat")),
            vertex(F.col("lon") + 0.004, F.col("lat") + bend),
            vertex(F.col("lon") + 0.008, F.col("lat")),
        ).alias("line"),
    )


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected stretches between the parts that follow one another in an order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("src"),
            F.lead("l_partkey").over(w).alias("dst"),
            F.col("l_quantity").alias("metres"),
            F.col("l_returnflag").alias("class"),
            (F.col("l_linestatus") == "F").alias("oneway"),
        )
        .filter("dst IS NOT NULL AND src <> dst")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street per order: a straight line with its parts as connectors at even distances, in the middle if there is but one."""
    from pyspark.sql import Window

    every = Window.partitionBy("l_orderkey")
    order = every.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.count(F.lit(1)).over(every)
    at = F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(order) - 1) / (n - 1))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(at.cast("double").alias("at"), F.col("l_partkey").cast("string").alias("connector_id")).alias("c"), "l_returnflag"
    )
    streets = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("c")).alias("connectors"), F.min("l_returnflag").alias("class"))
    lon, lat = key_lon(F.col("id")), key_lat(F.col("id"))
    return streets.withColumn("line", F.array(vertex(lon, lat), vertex(lon + 0.01, lat + 0.005)))


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = places(spark, sf_dir).select("id", "name", "category", "confidence", "lat", "lon")
    before = base.filter("id % 10 <> 0")
    after = base.filter("id % 10 <> 1").withColumn(
        "name", F.when(F.col("id") % 7 == 0, F.concat("name", F.lit(" II"))).otherwise(F.col("name"))
    )
    return before, after
