"""Tables that cut lineage: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 2**26  # of a filter: at most a million rows of two longs
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, a new temporary one for a local session, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="assay-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Spark drops the shuffle files of a query once its table is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table.

    A lost executor then costs a reread and no recomputation, and the shuffle files
    behind the table are freed. The folders belong to one job; delete them after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assay/{name}-{uuid.uuid4().hex}"
    with _shuffle_files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thinned(rows: DataFrame, keys: DataFrame, *columns: str, bits: int = _BITS) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are in no row of ``keys``, so that a shuffle after it is smaller.

    A bitmap has the bits that the hashes of ``keys`` point to. Its words, at most ``bits`` / 64 rows of
    two longs whatever the tables hold, are broadcast. No row that has a key leaves; of n keys about
    n / ``bits`` of the other rows stay (nearly all, once n is well above ``bits``), so what follows
    has to be right without the filter. Nulls are keys like any other; no keys leave no rows.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("__place")
    words = keys.select(place).groupBy(F.expr("__place div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(__place % 64)))").alias("__bits"))
    found = F.expr("__place div 64 = __word AND shiftright(__bits, int(__place % 64)) & 1 = 1")
    return rows.select("*", place).join(F.broadcast(words), found, "left_semi").drop("__place")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
