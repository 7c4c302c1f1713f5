"""What every operator needs of the session: tables, lineage cuts and hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Tables written in the shared folder, so that iterations neither repeat work nor grow their plan.

    Written tables outlive executors. `drop` removes one that is superseded; what is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._graphloom_path), True)


#: A key that holds more than this share of the rows is joined by broadcast; there are fewer than 1 / HOT such keys.
HOT = 1 / 128


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """The keys of a (key, n) table that hold more than HOT of all rows; fewer than 1 / HOT, none of them null."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col(n) > max(total * HOT, 1000))).select(key).collect()]


def unique_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join with a right side unique in `on`, however skewed the left side is.

    Keys that hold more than HOT of the left rows are given as hot (see hot_keys) or found by a count with map-side
    combining; fewer than 1 / HOT rows of the right side belong to them, and these are broadcast. The other rows are
    shuffled. how is inner or left; null keys find nothing.
    """
    if hot is None:
        hot = hot_keys(left.groupBy(on).agg(F.count("*").alias("n")), on, "n")
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return left.filter(is_hot).join(F.broadcast(right.filter(F.col(on).isin(hot))), on, how).unionByName(left.filter(~is_hot).join(right.filter(~F.col(on).isin(hot)), on, how))


def hashed_share(c: Column, k: int, n: int, seed: int = 0) -> Column:
    """Whether a value is among the about k of n values that a hash chooses; all of them if n is at most k.

    Each row is decided where it lies, so that a sample of bounded size costs no sort and sends nothing but itself to the driver.
    """
    return F.lit(True) if n <= k else F.pmod(F.xxhash64(F.lit(seed), c), F.lit(2**40)) < F.lit(2**40 * k // n)


def blank(c: Column | str) -> Column:
    """Null, or nothing but white space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"(?U)\S")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first of name_1, name_2 ... that is no column of df."""
    taken, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out
