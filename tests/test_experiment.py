from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegraph.__main__ import main
from tidegraph.plans import experiment
from tidegraph.sources.store import Project


def test_parameters():
    assert experiment.parsed([["a", "3"], ["b", "0.5"], ["c", "x"], ["d", "0", "1"]]) == {"a": 3, "b": 0.5, "c": "x", "d": (0.0, 1.0)}
    with pytest.raises(ValueError):
        experiment.parsed([["a"]])


def test_prepare_and_predict(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    pc, rs, start = [], [], datetime(2024, 1, 1)
    for c in range(10):  # user n follows n - 1 and, now and then, n - 2
        for i in range(6):
            pc.append((10 * c + i, f"c{c}", i, start + timedelta(hours=i)))
            if i:
                j = max(0, i - 1 - int(rng.random() < 0.2))
                rs.append((10 * c + i, 10 * c + j, i, j, start + timedelta(hours=i), start + timedelta(hours=j)))
    folder = f"file://{tmp_path}"
    spark.createDataFrame(pc, "post_id long, cascade_id string, author_id long, datetime timestamp").write.parquet(f"{folder}/postcascades")
    spark.createDataFrame(rs, "post_id long, reshared_post_id long, user_id long, ref_user_id long, datetime timestamp, ref_datetime timestamp").write.parquet(f"{folder}/reshares")
    main(["prepare", folder, "--min-depth", "1"])
    p = Project(spark, folder, "project")
    assert p.load("samples").where("split = 'test'").count() == 3
    main(["stats", folder])
    main(["predict", folder, "-m", "emic", "--param", "threshold", "0.3", "--param", "iterations", "2"])
    result = p.load("metrics", "emic").first()
    assert result["threshold"] == 0.3 and result["recall"] > 0.9
    main(["prune", folder, "--min-degree", "3"])
    small = Project(spark, folder, "project-pruned")
    assert small.load("samples").count() > 0 and small.load("sequences").where("t > max_t").isEmpty()
    main(["predict", folder, "-p", "project-pruned", "-m", "emic", "--param", "threshold", "0.3", "--param", "iterations", "1"])
    main(["ttest", folder, "-m", "emic", "daic", "-t", "0.2"])
    main(["tree", folder])
    data = experiment.Data(p.load("trees"), p.load("sequences"))
    deep = experiment.scores("emic", data, p.load("samples"), p.load("samples"), [0.3], init_depth=9, iterations=1)
    assert deep.count() == 10 and deep.where("f1 is not null").count() == 0
    assert "c0" not in experiment.side_by_side(data.nodes, data.nodes, "c0") and capsys.readouterr().out
