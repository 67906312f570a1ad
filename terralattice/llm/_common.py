"""Shared plumbing: scratch tables in the cluster's shared folder, free column names, row keys, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case, the other bytes as they are.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows and bytes of one Arrow batch, and rows that the Parquet reader decodes at once; whole texts fit a task's memory at these sizes.
#: Every operator sets the same values, so a plan that runs later runs under them too.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 2048, 2 << 20, 256

_own_scratch: list[str] = []
_scratch: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch tables ------------------------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="terralattice-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return f"file://{_own_scratch[0]}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends is removed then."""
    if not _scratch:
        atexit.register(_sweep)
    path = f"{scratch_dir(spark)}/terralattice-{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scratch[path] = (target.getFileSystem(spark._jsc.hadoopConfiguration()), target)
    return path


def remove_path(path: str) -> None:
    system, target = _scratch.pop(path)
    system.delete(target, True)


def _sweep() -> None:
    for path in list(_scratch):
        with contextlib.suppress(Exception):  # the driver's JVM may be gone before us
            remove_path(path)


#: Rows of a file of a table whose number of rows is bounded beforehand.
FILE_ROWS = 200_000


class Stored:
    """A written table that cuts lineage; ``drop`` frees its space once no plan reads it, the driver's end does at the latest.

    Where the number of rows has a known bound, ``at_most``, the table gets as few files as that asks for.
    """

    def __init__(self, df: DataFrame, tag: str, at_most: int | None = None, file_rows: int = FILE_ROWS):
        self.path = scratch_path(df.sparkSession, tag)
        if at_most is not None:
            df = df.coalesce(max(1, -(-at_most // file_rows)))
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    @property
    def rows(self) -> int:
        """The number of rows, out of the files' footers."""
        return self.df.count()

    def drop(self) -> None:
        remove_path(self.path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


# --- sessions ------------------------------------------------------------------------------------

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package once per application, for clusters where it isn't installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="terralattice-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds batches by rows and bytes, so that a batch of long texts fits a task and its worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# --- columns -------------------------------------------------------------------------------------


def free_prefix(df: DataFrame, names, prefix: str = "_") -> str:
    """``prefix``, lengthened by underscores until ``df`` has none of the names behind it, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return prefix


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: ``run`` goes by position."""
    names = [f"c{i}" for i in range(len(schema))]

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(renamed, plain).toDF(*schema.names)


def apart(c: Column) -> Column:
    """The same long behind an expression, for a join right after an aggregate on it.

    The planner then shuffles both sides for the join instead of keeping the aggregate's partitioning, and adaptive
    execution can split a hot key.
    """
    return c.bitwiseXOR(F.lit(0).cast("long"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_hash(c: Column) -> Column:
    """64-bit hash of a text; with the id beside it, it tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(c, F.lit("")), c.isNull())


def salted_id_fraction(c: Column) -> Column:
    """A pseudo-random number in [0, 1) fixed by the id."""
    return F.pmod(F.xxhash64(F.lit("sample"), c), F.lit(1 << 30)) / F.lit(float(1 << 30))


# --- arrays --------------------------------------------------------------------------------------


def texts_of(values: pa.Array) -> list[bytes]:
    """Each value's UTF-8 bytes; null is empty."""
    return [b"" if v is None else v for v in values.cast(pa.large_binary()).to_pylist()]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of ``counts[i]`` numbers each, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before, counts) + np.repeat(starts, counts)


def joined_spans(spans) -> list[tuple[int, int]]:
    """Half-open spans, sorted, with those joined that touch or overlap."""
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x
