"""Cutting lineage between the rounds of a loop, and files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named a local one is set, but only where driver and executors are one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: like settled, with one run of the plan."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """A table of the shared folder to which each round of a loop adds rows: it is one scan however many rounds there were, and no round writes again what others wrote."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.rounds = spark, shared_path(spark, name), 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """df as it was written, and its number of rows."""
        seen, path = Observation(), f"{self.path}/{self.rounds:06}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.schema, self.rounds = df.schema, self.rounds + 1
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def whole(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


#: Rows of a frontier up to which what is active already is looked up for its candidates alone.
FEW = 20_000


def fresh(found: DataFrame, done: DataFrame, key: list[str], few: bool) -> DataFrame:
    """Rows of found whose key is not in done. few: found is small, so it goes to the rows of done, which stay where they are."""
    if few:
        done = F.broadcast(done.select(*key).join(F.broadcast(found.select(*key)), key, "left_semi"))  # no more rows than found has
    return found.join(done.select(*key), key, "left_anti")


#: Rows of one receiver from which on it is dealt over several slots.
HOT = 1_000_000


def slots(rows: DataFrame, key: str, other: str, hot: int | None = None) -> DataFrame:
    """rows with a column slot: one for each value of key, and for a value with more than ``hot`` rows as many as keep each below that, chosen by the hash of other."""
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (hot or HOT))
    pieces = F.coalesce(F.ceil(F.col("__n") / (hot or HOT)), F.lit(1))
    return rows.join(size, key, "left").withColumn("slot", F.xxhash64(key, F.pmod(F.xxhash64(other), pieces))).drop("__n")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df hashed by key for work that is long for its bytes: a number of partitions that is given is kept, while small ones would else be merged until few cores have work."""
    return df.repartition(_many(df.sparkSession), key)


def _many(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def gathered(df: DataFrame, key: str) -> DataFrame:
    """df hashed by key as all tables are that go through here: joins and sums that have key among their columns find the rows where they lie, and small partitions are not merged.

    Joins on more columns than key count as co-located: that is Spark's setting requireAllClusterKeysForCoPartition, which is put off for the session.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spread(df, key)


def kept(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, whose rows gathered() has hashed by key, as a table of the shared folder that lies the same way: no row is shuffled to write it, nor for what is joined, windowed or summed by key after."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(_many(spark), key).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def bucketed(df: DataFrame, name: str, key: str = "slot") -> DataFrame:
    """df as a table of the shared folder that is hashed by key once, into as many buckets as shuffles have partitions. Joins and sums that have key among their columns read it as it lies.

    Joins on more columns than key count as co-located too: that is Spark's setting requireAllClusterKeysForCoPartition, which is put off for the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(many, key).write.bucketBy(many, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def settled(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the session's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
