"""What several operators of this subpackage share: scratch tables and keys of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that a Python worker gets, so that workers stay small whatever the size of the rows.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes too, unless they are bounded closer already. Without it a batch has 10,000 rows of any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores after it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for Spark, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: its lineage ends there.

    A lost executor then costs a new read of files that all executors see, not a new run of the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a document row that is never null.

    Rows that share doc_id but not text get different keys; rows equal in both share one.
    """
    return F.concat_ws(
        ":",
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"),
        F.when(F.col(text).isNull(), "n").otherwise("t"),
    )
