"""Rule and evidence texts for a Markov-logic learner, and its weights read back. The learner itself is an external program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed texts of the three dialects: rule, evidence of an activation, evidence of a trial.
DIALECTS = {
    "alchemy": ("!isActivated(N{u}, c) v activates(N{u}, N{v}, c)", 'isActivated(N{u}, C{c})', "activates(N{u}, N{v}, C{c})"),
    "tuffy": ('!isActivated("N{u}", c) v activates("N{u}", "N{v}", c)', 'isActivated("N{u}", "C{c}")', 'activates("N{u}", "N{v}", "C{c}")'),
    "pracmln": ("!isActivated(N{u}, ?c) v activates(N{u}, N{v}, ?c)", "isActivated(N{u}, C{c})", "activates(N{u}, N{v}, C{c})"),
}


def _text(pattern: str):
    out = F.lit(pattern)
    for mark in ("u", "v", "c"):
        if "{" + mark + "}" in pattern:
            out = F.replace(out, F.lit("{" + mark + "}"), F.col(mark).cast("string"))
    return out


def rules(edges: DataFrame, dialect: str = "tuffy") -> DataFrame:
    """value: a rule per edge, with weight 0 to be learned."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).select(F.concat(F.lit("0 "), _text(DIALECTS[dialect][0])).alias("value"))


def evidence(nodes: DataFrame, dialect: str = "tuffy") -> DataFrame:
    """value: who is active and who activated whom."""
    n = nodes.select(F.col("parent_id").alias("u"), F.col("user_id").alias("v"), F.col("cascade_id").alias("c"))
    on = n.select(F.col("v").alias("u"), "c").select(_text(DIALECTS[dialect][1]).alias("value"))
    return on.union(n.where("u is not null").select(_text(DIALECTS[dialect][2]).alias("value")))


def weights(spark: SparkSession, path: str, end: str = "") -> DataFrame:
    """u, v, weight from a result text, or a folder of them, each up to its first line that starts with ``end``. A file is one program's output: small, and read in order."""
    lines = F.split("value", "\n")
    if end:
        stop = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(end))), F.lit(True))
        lines = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    lines = spark.read.text(path, wholetext=True).select(F.explode(lines).alias("line"))
    pattern = r'^\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s+!isActivated.*activates\("N(\d+)",\s*"N(\d+)"'
    hit = lines.where(F.col("line").rlike(pattern))
    part = lambda i, kind: F.regexp_extract("line", pattern, i).cast(kind)
    return hit.select(part(2, "long").alias("u"), part(3, "long").alias("v"), part(1, "double").alias("weight"))


def normalised(weights: DataFrame) -> DataFrame:
    """u, v, k: weights between 0 and 1; all 1 if they are equal."""
    ends = weights.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return weights.crossJoin(F.broadcast(ends)).select("u", "v", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("k"))  # ends: one row


