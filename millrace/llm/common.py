"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster gets an error,
    since a machine-local folder would lose its files with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`table` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that isn't there is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: In a worker: what operators keep there between their tasks, as the function that lets go of it.
KEPT: dict[str, Callable[[], None]] = {}


def release(but: str = "") -> None:
    """In a worker: let go of what other operators' tasks have left there, and give freed memory back to the machine.

    Workers live on from one operator to the next, so that without this the largest state of each would add up.
    """
    for name in [n for n in KEPT if n != but]:
        KEPT.pop(name)()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the actions inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of a key from which a lookup deals them out, and over how many places.
HOT, PLACES = 2_000, 64


def look_up(rows: DataFrame, key: str, known: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``known`` (one row for each ``key``, under the same name), whatever share of the rows has one key.

    The rows of keys that stand in more than ``HOT`` rows are dealt out over ``PLACES`` by a hash of the column ``spread``
    and those keys' entries are repeated for each place. There are at most rows / ``HOT`` such keys; they are broadcast
    while they are fewer than a hundred thousand and joined by a shuffle beyond. ``rows`` should be a written table, since its keys
    are counted first.
    """
    hot = table(rows.groupBy(key).count().where(F.col("count") > HOT).where(F.col(key).isNotNull()).select(F.col(key).alias("_hot")), "hot")
    n = hot.count()
    if not n:
        drop(hot)
        return rows.join(known, key, how)
    few = F.broadcast(hot) if n < 100_000 else hot
    place = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(PLACES)).cast("int")).otherwise(0)
    left = rows.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_place", place).drop("_hot")
    places = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    right = known.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_place", F.explode(places)).drop("_hot")
    return left.join(right, [key, "_place"], how).drop("_place")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
