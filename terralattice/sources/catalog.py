"""Datasets of a release: where they lie, their columns, and frames that have all of them."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    theme: str
    kind: str
    columns: dict[str, str] = field(default_factory=dict)  # name to Spark type

    def path(self, base: str, release: str) -> str:
        return f"{base}/{release}/theme={self.theme}/type={self.kind}"


BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

PLACES = Dataset(
    "places",
    "place",
    {
        "id": "string",
        "bbox": BBOX,
        "names": "struct<primary:string>",
        "taxonomy": "struct<primary:string,alternates:array<string>>",
        "basic_category": "string",
        "operating_status": "string",
        "confidence": "double",
        "addresses": "array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>",
        "websites": "array<string>",
        "phones": "array<string>",
        "socials": "array<string>",
        "brand": "struct<names:struct<primary:string>>",
    },
)
DIVISION_AREAS = Dataset(
    "divisions",
    "division_area",
    {"id": "string", "names": "struct<primary:string>", "subtype": "string", "country": "string", "geometry": "binary", "bbox": BBOX, "division_id": "string"},
)
ADDRESSES = Dataset(
    "addresses",
    "address",
    {"id": "string", "bbox": BBOX, "country": "string", "number": "string", "street": "string", "unit": "string", "postcode": "string", "postal_city": "string"},
)
BUILDINGS = Dataset(
    "buildings",
    "building",
    {"id": "string", "geometry": "binary", "bbox": BBOX, "subtype": "string", "class": "string", "height": "double", "num_floors": "int"},
)
SEGMENTS = Dataset(
    "transportation",
    "segment",
    {"id": "string", "geometry": "binary", "bbox": BBOX, "class": "string", "connectors": "array<struct<connector_id:string,at:double>>"},
)
FEATURES = {
    kind: Dataset("base", kind, {"id": "string", "geometry": "binary", "bbox": BBOX, "subtype": "string", "class": "string", "names": "struct<primary:string>"})
    for kind in ("water", "infrastructure", "land_use", "land_cover")
}


class Catalog:
    """Resolves datasets of one release.  Overrides are paths by (release, kind): those of another release don't apply.

    Without a release the one in the environment counts, else the newest that is listed, else the pinned one.
    """

    def __init__(self, spark: SparkSession, base: str, release: str | None = None, overrides: dict[tuple[str, str], str] | None = None, pinned: str = ""):
        self.spark, self.base, self.overrides, self.failed = spark, base, overrides or {}, {}
        self.release = release or os.environ.get("TERRALATTICE_RELEASE") or next(iter(self.releases()), pinned)

    def releases(self) -> list[str]:
        """The releases under the base folder, newest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted_releases(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []

    def where(self, dataset: Dataset) -> str:
        return self.overrides.get((self.release, dataset.kind)) or dataset.path(self.base, self.release)

    def probe(self, dataset: Dataset) -> T.StructType | None:
        """The columns that a dataset's files have; None if they cannot be read, which is remembered."""
        path = self.where(dataset)
        if path in self.failed:
            return None
        try:
            return self.spark.read.parquet(path).schema
        except AnalysisException as e:
            self.failed[path] = str(e)
            return None

    def read(self, dataset: Dataset, paths: Iterable[str] | None = None) -> DataFrame:
        """The dataset with every column it should have; hive partitions are found by Spark, explicit files are read as given."""
        if paths is not None:
            return conform(self.spark.read.parquet(*paths), dataset.columns)
        return conform(self.spark.read.parquet(self.where(dataset)), dataset.columns)


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns that the files lack as nulls of their type; others pass through."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def fingerprint(df: DataFrame) -> str:
    """Twelve hex digits that change with the set of columns."""
    return hashlib.sha256(",".join(sorted(df.columns)).encode()).hexdigest()[:12]


def geometry_kind(schema: T.StructType, column: str = "geometry") -> str:
    """How a geometry is stored: wkb, text, struct or none."""
    if column not in schema.fieldNames():
        return "none"
    kind = schema[column].dataType
    return "wkb" if isinstance(kind, T.BinaryType) else "text" if isinstance(kind, T.StringType) else "struct"


def sorted_releases(names: Iterable[str]) -> list[str]:
    """Releases named date.patch, newest first, patches by number."""
    found = [m for n in names if (m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})\.(\d+)", n.strip("/")))]
    return [m[0] for m in sorted(found, key=lambda m: (m[1], int(m[2])), reverse=True)]


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """slug and its path from root to leaf, out of ``code; [a,b,c]`` lines with an optional byte-order mark."""
    raw = spark.read.csv(path, sep=";", header=True)
    raw = raw.toDF(*(c.replace("﻿", "").strip() for c in raw.columns))
    code, path_column = raw.columns[:2]
    return raw.select(
        F.trim(code).alias("slug"), F.split(F.regexp_replace(F.trim(path_column), r"[\[\]\s]", ""), ",").alias("path")
    )


def mirror(df: DataFrame, path: str) -> int:
    """Copies a table and verifies the number of rows, which are counted as they are written."""
    from pyspark.sql import Observation

    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    before, after = written.get["n"], df.sparkSession.read.parquet(path).count()
    if before != after:
        raise OSError(f"{after} rows of {before} arrived in {path}")
    return after
