"""Cutting lineage by tables in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine uses a temporary
    folder, and any other is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: what follows reads it there, knows its
    size, and recomputes nothing where an executor is lost."""
    spark = df.sparkSession
    path = f"{folder(spark)}/weftline/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """cut(df), of a table that grows with the corpus. What files hold is packed many times denser than
    rows are, so that by their size joins would send tables whole through the driver that do not
    fit there: such a table is shuffled to its joins."""
    return cut(df).hint("merge")


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of equal keys in one partition. Distinct rows, windows and joins by these keys
    and others then need no exchange of their own, at any size: joins may be by more columns than
    those that rows are dealt by, and no table is sent whole in place of its exchange."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


class Parts:
    """A table that grows by parts, each computed once and written to a folder of its own. What reads
    it has one scan, however many parts there are, so that plans of loops do not grow with turns.
    It is shuffled to its joins, as grown() tables are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, f"{folder(spark)}/weftline/parts-{uuid.uuid4().hex}", None
        atexit.register(_remove, spark, self.path)

    def add(self, df: DataFrame, part: int) -> DataFrame:
        """df as this part of the table, read from there."""
        self.schema = df.schema if self.schema is None else self.schema
        df.write.parquet(f"{self.path}/part={part}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={part}").hint("merge")

    def read(self, parts: str = "true") -> DataFrame:
        """The parts(part) of which the condition holds."""
        schema = StructType([*self.schema.fields, StructField("part", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path).where(parts).drop("part").hint("merge")
