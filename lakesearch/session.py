"""Sessions: settings for local runs, the package for Python workers elsewhere, tables that cut a lineage."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local(cpus: int, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def ship(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Give workers the package once per application, unless their path has it already."""

    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app not in _shipped and str(PACKAGE.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            folder = tempfile.mkdtemp()  # the driver serves the archive to all executors
            spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
        _shipped.add(app)
        return run(spark, sf_dir)

    return shipped


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a local session may get one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lakesearch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found := f"file://{own}")
    return found.rstrip("/")


#: Tables under so many bytes may be one row group and thus one task: dealing them out costs a shuffle of that at most.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Before costly work on each row: deal a small table out to all cores; a large one has splits enough. of: the
    whole table, where df is some of its columns."""
    size = (of or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SPREAD_BYTES else df


#: Rows and bytes of an Arrow batch of whole texts; a batch holds one row at least.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole texts in rows and bytes. Spark has only a session's setting for that; a
    session with smaller bounds keeps them."""
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)i?b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= bound:
            spark.conf.set(key, bound)


#: So many rows of ids, 30 MB or so, are broadcast.
FEW = 1 << 18


def few(df: DataFrame) -> DataFrame:
    """Rows of a stored table: broadcast, if they are proven to be few; then what they join isn't shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, whatever executors are lost later."""
    path = f"{shared_dir(df.sparkSession)}/lakesearch/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
