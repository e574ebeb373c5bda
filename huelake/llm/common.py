"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Largest table, in rows, that `attach` broadcasts; above it the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 32


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder the session names in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            local = sc.master.startswith("local[") or sc.master == "local"
            folder = "/tmp/checkpoints/huelake" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(folder)
        remove(spark, sc.getCheckpointDir(), at_exit=True)
    return df.checkpoint()


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder of any file system, now or when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        files.deleteOnExit(place)
    else:
        files.delete(place, True)


def attach(left: DataFrame, table: DataFrame, key: str, spread: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of `table` (unique on `key`) to `left`, where one key may hold a third of the rows.

    The table's size is counted first: up to `limit` rows it is broadcast, beyond that
    it is replicated over salts, and `left` picks a salt by the hash of column `spread`.
    """
    if table.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(table), key, "left")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    spreaded = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spreaded, [key, "__salt"], "left").drop("__salt")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; the split of labelled rows."""
    return F.crc32(F.col(column).cast("string")) % n


def give_back() -> None:
    """Returns freed memory to the system: a worker lives through several stages, and its heap would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slots(spark: SparkSession, n: int, most: int = 4096) -> Callable[[Column], Column]:
    """Maps a number below n to an integer that hash partitioning into n puts in a partition of its own.

    Beyond `most` numbers it is the number itself: with so many, chance spreads them well enough.
    """
    if n <= most:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = dict(spark.range(0, 32 * n, 1, 1).groupBy(place.alias("place")).agg(F.min("id")).collect())
        if len(found) == n:
            table = F.lit([found[i] for i in range(n)])
            return lambda part: F.element_at(table, part.cast("int") + 1).cast("int")
    return lambda part: part.cast("int")
