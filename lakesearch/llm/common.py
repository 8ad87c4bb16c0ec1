"""What the operators share: the cluster's shared folder, written stage tables, tokenisers.

Every operator that needs a stable intermediate result writes it as a Parquet table into the folder
named by ``spark.checkpoint.dir``. Such a table cuts the lineage, survives the loss of any executor
and carries no driver state.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, shared_dir, small_batches  # noqa: F401

#: ASCII white space: the bytes ``[\x20\x09-\x0D]``; ``bytes.split()`` cuts at exactly these.
SPACES = b" \t\n\r\x0b\x0c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z, keeps 0-9, a-z and everything beyond ASCII, and turns the rest into blanks.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return [] if not text else text.encode("utf-8", "replace").translate(_WORDS).split()


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; only A-Z are lower-cased (``bytes.lower`` is ASCII)."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


#: Of equal share: a key with more than one of so many parts of the rows is hot. Tables of few rows have none.
HOT_PARTS, FEW_ROWS = 1000, 20_000
_scopes: list[list[str]] = []


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession, tag: str) -> str:
    root = f"{shared_dir(spark)}/lakesearch/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(root)
    return f"{root}/{tag}"


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete every table that is written inside, but for those of ``kept``, at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_path(spark, path)


def kept(table: DataFrame) -> DataFrame:
    """Let a table of ``materialize`` outlive the innermost ``passing``."""
    if _scopes:
        root = table.lakesearch_path.rpartition("/")[0]
        _scopes[-1].remove(root)
        if len(_scopes) > 1:
            _scopes[-2].append(root)
    return table


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write as a table in the shared folder and read it back: cuts lineage and computes once."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lakesearch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "lakesearch_path", None):
            drop_path(table.sparkSession, path)


def spread_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt: tuple[str, ...] = (), counts: DataFrame | None = None
) -> DataFrame:
    """Equi join with a right side of one row a key, in which the left rows of a hot key share no task.

    A key is hot with more than one of ``HOT_PARTS`` parts of the left rows, so there are fewer than
    HOT_PARTS such keys whatever the data, and these and their sizes may come to the driver. The rows of a
    hot key are dealt into as many parts as it has such shares by a hash of the columns ``salt`` (all by
    default); its right row is repeated for each part, which makes HOT_PARTS rows more at most in all.
    counts: (key, n) of the left rows, if known; else left is to be a written table, as it is read twice.
    """
    if (total := left.count() if counts is None else (counts.agg(F.sum("n")).first()[0] or 0)) <= FEW_ROWS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.filter((F.col("n") * HOT_PARTS > total) & F.col(key).isNotNull()).select(key, "n").collect()
    if not hot:
        return left.join(right, key, how)
    parts, place = spare(left.join(right.limit(0), key), "parts"), spare(left.join(right.limit(0), key), "place")
    kind = left.schema[key].dataType.simpleString()
    sizes = F.broadcast(
        left.sparkSession.createDataFrame([(r[0], math.ceil(r[1] * HOT_PARTS / total)) for r in hot], f"`{key}` {kind}, `{parts}` int")
    )
    n = F.coalesce(parts, F.lit(1))
    dealt = left.join(sizes, key, "left").withColumn(place, F.pmod(F.xxhash64(*(salt or left.columns)), n)).drop(parts)
    copies = right.join(sizes, key, "left").withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))).drop(parts)
    return dealt.join(copies, [key, place], how).drop(place)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold_of(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
