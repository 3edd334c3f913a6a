"""Commands on the posts and reshares of a folder: ``python -m tidegraph COMMAND FOLDER ...`` with postcascades and reshares as Parquet in it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import cascades, evaluate, graphs, sampling, sequences, trees
from tidegraph.plans import experiment
from tidegraph.plans.loops import settled
from tidegraph.sources.store import Project


def loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postcascades"), spark.read.parquet(f"{folder}/reshares")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("prepare", "sample, split, trees, sequences and graph of a project"), ("stats", "sizes and depths"), ("predict", "train, predict and score"), ("prune", "degrees and a project without users of low degree"), ("compare", "methods by depth of the given trees"), ("ttest", "Student's t of two methods"), ("tree", "trees as text")):
        c = sub.add_parser(name, help=text)
        c.add_argument("folder")
        c.add_argument("-p", "--project", default="project")
        if name == "prepare":
            c.add_argument("-n", "--number", type=int)
            c.add_argument("--min-size", type=int)
            c.add_argument("--max-size", type=int)
            c.add_argument("--min-depth", type=int)
            c.add_argument("--seed", type=int, default=0)
        if name in ("compare", "ttest"):
            c.add_argument("-m", "--methods", nargs=2 if name == "ttest" else "+", choices=sorted(experiment.METHODS), required=True)
            c.add_argument("-i", "--depths", nargs=1 if name == "ttest" else "+", type=int, default=[0])
            c.add_argument("-t", "--threshold", type=float, default=0.5)
        if name == "tree":
            c.add_argument("-n", "--number", type=int, default=1)
        if name == "prune":
            c.add_argument("--min-degree", type=int, default=2)
        if name == "predict":
            c.add_argument("-m", "--method", choices=sorted(experiment.METHODS), required=True)
            c.add_argument("-C", "--criterion", choices=("nodes", "edges"), default="nodes")
            c.add_argument("-i", "--init-depth", type=int, default=0)
            c.add_argument("-d", "--max-depth", type=int)
            c.add_argument("--param", nargs="+", action="append", default=[])
            c.add_argument("-n", "--thresholds", type=int, default=10)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = Project(spark, a.folder, a.project)
    if a.command == "prepare":
        pc, reshares = loaded(spark, a.folder)
        nodes = trees.trees(reshares, pc)
        all_ = cascades.with_depth(cascades.attributes(pc), nodes)
        chosen = cascades.filtered(all_, a.min_size, a.max_size, a.min_depth)
        ids = sampling.sample(chosen, a.number, a.seed) if a.number else chosen.select("cascade_id")
        project.save(sampling.train_test(ids, seed=a.seed), "samples")
        ids = project.load("samples")
        project.save(nodes.join(ids, "cascade_id", "left_semi"), "trees")
        project.save(sequences.activations(pc, all_).join(ids, "cascade_id", "left_semi"), "sequences")
        train = project.load("trees").join(ids.where("split = 'training'"), "cascade_id", "left_semi")
        project.save(graphs.from_trees(train), "graph")
    elif a.command == "stats":
        cascades.project_stats(project.load("trees")).show()
        trees.summary(project.load("trees")).orderBy("size").show()
    elif a.command == "prune":
        nodes = project.load("trees")
        graphs.degrees(trees.edges(nodes).select("src", "dst")).orderBy("total", "in_degree").show()
        smaller = Project(spark, a.folder, f"{a.project}-pruned")
        low = settled(graphs.low_degree(nodes, a.min_degree))
        smaller.save(trees.with_edges(trees.pruned(nodes, low)), "trees")
        left = smaller.load("trees")
        smaller.save(graphs.without(project.load("graph"), low), "graph")
        smaller.save(project.load("samples").join(left.select("cascade_id").distinct(), "cascade_id", "left_semi"), "samples")
        smaller.save(sequences.pruned(project.load("sequences"), low, left), "sequences")
    elif a.command == "tree":
        ids = project.load("trees").select("cascade_id").distinct().orderBy("cascade_id").limit(a.number)
        for r in ids.collect():
            print(r["cascade_id"], experiment.side_by_side(project.load("trees"), project.load("trees"), r["cascade_id"]), sep="\n")
    elif a.command in ("compare", "ttest"):
        data, ids = experiment.Data(project.load("trees"), project.load("sequences")), project.load("samples")
        train, test = ids.where("split = 'training'"), ids.where("split = 'test'")
        if a.command == "compare":
            report = experiment.compare(a.methods, data, train, test, a.threshold, [(i, None) for i in a.depths])
            report.orderBy("method", "init_depth").show(1000, False)
            project.save(report, "metrics", "compare")
        else:
            first, second = (experiment.scores(m, data, train, test, [a.threshold], a.depths[0]).select(F.lit(g).alias("grp"), F.col("f1").alias("value")) for m, g in zip(a.methods, "ab", strict=True))
            evaluate.t_test(first.unionByName(second)).show()
    else:
        data, ids = experiment.Data(project.load("trees"), project.load("sequences")), project.load("samples")
        train, test = ids.where("split = 'training'"), ids.where("split = 'test'")
        given = experiment.parsed(a.param)
        threshold = given.pop("threshold", (0.0, 1.0))
        options = {"init_depth": a.init_depth, "max_depth": a.max_depth, "on": a.criterion, **given}
        if isinstance(threshold, tuple):
            threshold, means = experiment.tune(a.method, data, train, evaluate.grid(*threshold, a.thresholds), **options)
            means.orderBy("threshold").show()
            evaluate.auc(evaluate.roc(means)).show()
        result = evaluate.mean_metrics(experiment.scores(a.method, data, train, test, [float(threshold)], **options), ("threshold",))
        result.show()
        project.save(result, "metrics", a.method)


if __name__ == "__main__":
    main()
