"""Derived data of a project as typed Parquet: one folder for each artefact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Artefacts of a project.
ARTEFACTS = ("samples", "trees", "sequences", "graph", "params", "evidences", "models", "metrics")


def set_key(ids: DataFrame) -> str:
    """A key of a set of cascades, whatever their order."""
    row = ids.select(F.xxhash64(F.col("cascade_id").cast("string")).alias("h")).distinct().agg(F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1000003).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{(row['x'] or 0) & (1 << 64) - 1:016x}-{row['s'] or 0}-{row['n']}"


@dataclass
class Project:
    spark: SparkSession
    root: str
    name: str

    def path(self, artefact: str, key: str = "") -> str:
        if artefact not in ARTEFACTS:
            raise ValueError(f"no artefact {artefact}")
        return "/".join(x for x in (self.root.rstrip("/"), self.name, artefact, key) if x)

    def save(self, df: DataFrame, artefact: str, key: str = "") -> None:
        df.write.mode("overwrite").parquet(self.path(artefact, key))

    def load(self, artefact: str, key: str = "") -> DataFrame:
        return self.spark.read.parquet(self.path(artefact, key))

    def has(self, artefact: str, key: str = "") -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(artefact, key) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load_or(self, artefact: str, make: Callable[[], DataFrame], key: str = "") -> DataFrame:
        """The artefact if it is there, else made, saved and read back."""
        if not self.has(artefact, key):
            self.save(make(), artefact, key)
        return self.load(artefact, key)


def trees_to_json(nodes: DataFrame) -> DataFrame:
    """cascade_id, json: a forest of nested nodes, one text for each cascade."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        import json

        children: dict = {}
        for r in df.sort_values(["act_time", "user_id"]).itertuples():
            children.setdefault(None if pd.isna(r.parent_id) else r.parent_id, []).append(r)

        made: dict = {}
        order, queue = [], list(children.get(None, []))
        while queue:
            r = queue.pop()
            order.append(r)
            queue += children.get(r.user_id, [])
        for r in reversed(order):
            made[r.user_id] = {"user_id": str(r.user_id), "datetime": r.act_time.isoformat(sep=" "), "children": [made[c.user_id] for c in children.get(r.user_id, [])]}
        return pd.DataFrame({"cascade_id": [df["cascade_id"].iloc[0]], "json": [json.dumps([made[r.user_id] for r in children.get(None, [])])]})

    return nodes.select("cascade_id", "user_id", "parent_id", "act_time").groupBy("cascade_id").applyInPandas(run, "cascade_id string, json string")


def trees_from_json(texts: DataFrame) -> DataFrame:
    """Nodes (ids as strings) of cascade_id, json."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for df in batches:
            out = []
            for cascade, text in zip(df["cascade_id"], df["json"], strict=True):
                queue = [(n, None, 0) for n in json.loads(text)]
                while queue:
                    n, parent, depth = queue.pop()
                    out.append((cascade, n["user_id"], parent, pd.Timestamp(n["datetime"]), depth))
                    queue += [(c, n["user_id"], depth + 1) for c in n["children"]]
            yield pd.DataFrame(out, columns=["cascade_id", "user_id", "parent_id", "act_time", "depth"])

    return texts.mapInPandas(run, "cascade_id string, user_id string, parent_id string, act_time timestamp, depth int")


def save_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as tab-separated text with a head, or as JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    else:
        df.write.mode("overwrite").json(path)


def roc_results(spark: SparkSession, path: str, project: str, criterion: str) -> DataFrame:
    """method, fpr, tpr of the JSON results whose file names hold project and criterion, named ``<project>-<method>-<criterion>...``."""
    raw = spark.read.schema("fpr array<double>, tpr array<double>").json(path).withColumn("file", F.input_file_name())
    hit = raw.where(F.col("file").contains(project) & F.col("file").contains(criterion))
    method = F.regexp_extract("file", rf"{project}-(\w+)-", 1)
    return hit.select(method.alias("method"), F.explode(F.arrays_zip("fpr", "tpr")).alias("p")).select("method", "p.fpr", "p.tpr")
