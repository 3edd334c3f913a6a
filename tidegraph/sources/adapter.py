"""The social schema from the table ``events``: posts, their cascades, and reshares by a binary heap over each cascade's posts in time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postcascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, cascade_id, author_id, datetime: an event type and a day make a cascade."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("post_id"),
        F.concat_ws("-", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("cascade_id"),
        F.col("user_id").alias("author_id"),
        F.col("ts").alias("datetime"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postcascades(spark, sf_dir).select("post_id", "author_id", "datetime", F.lit(None).cast("string").alias("url"))


def reshares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, reshared_post_id, user_id, ref_user_id, datetime, ref_datetime: post number n of a cascade reshares number n div 2."""
    w = Window.partitionBy("cascade_id").orderBy("datetime", "post_id")
    ranked = postcascades(spark, sf_dir).withColumn("rn", F.row_number().over(w))
    child = ranked.where("rn > 1").select("cascade_id", (F.col("rn") / 2).cast("int").alias("rn"), "post_id", F.col("author_id").alias("user_id"), "datetime")
    parent = ranked.select("cascade_id", "rn", F.col("post_id").alias("reshared_post_id"), F.col("author_id").alias("ref_user_id"), F.col("datetime").alias("ref_datetime"))
    return child.join(parent, ["cascade_id", "rn"]).select("post_id", "reshared_post_id", "user_id", "ref_user_id", "datetime", "ref_datetime")


@dataclass
class Social:
    """The tables of one data set."""

    postcascades: DataFrame
    reshares: DataFrame


def social(spark: SparkSession, sf_dir: str) -> Social:
    return Social(postcascades(spark, sf_dir), reshares(spark, sf_dir))
