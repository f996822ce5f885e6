import json

import pytest
from pyspark.sql import functions as F

from sondera import cli


def test_all_stages_and_resume(spark, tmp_path):
    out = str(tmp_path / "run")
    (tmp_path / "s.json").write_text('{"foreground_minimum": 0.75}')
    with pytest.raises(ValueError, match="without foreground"):
        cli.main(["all", "--data", "/root/testdata/sf0.001", "--output", str(tmp_path / "none"), "--settings", str(tmp_path / "s.json")])
    (tmp_path / "s.json").write_text('{"foreground_minimum": 0.7}')
    given = ["--data", "/root/testdata/sf0.001", "--output", out, "--settings", str(tmp_path / "s.json")]
    cli.main(["all", *given])
    plan = spark.read.parquet(f"file://{out}/plan")
    assert plan.where("occupancy < 0.7").count() > 0
    for saved, roles in (("bank/patches", "role = 'bank'"), ("evidence", "role IN ('calibration', 'evaluation')")):
        assert spark.read.parquet(f"file://{out}/{saved}").count() == plan.where("occupancy >= 0.7").where(roles).count()
    assert spark.read.json(f"file://{out}/cluster_composition").count() == 8 and "silhouette_euclidean_labels" in (tmp_path / "run/cluster_report.md").read_text()
    metrics = {r.method: r for r in spark.read.json(f"file://{out}/metrics").collect()}
    assert set(metrics) == {"nearest", "topk"} and all(0 <= m.auroc <= 1 for m in metrics.values())
    assert spark.read.json(f"file://{out}/ablation_report").count() == 4
    before = spark.read.parquet(f"file://{out}/evidence").count()
    fresh = spark.read.json(f"file://{out}/scores").agg(F.sum("score")).first()[0]
    cli.main(["score", *given])
    assert spark.read.parquet(f"file://{out}/evidence").count() == before
    assert abs(spark.read.json(f"file://{out}/scores").agg(F.sum("score")).first()[0] - fresh) < 1e-9
    base, capped = (spark.read.json(f"file://{out}/{t}").where(w).agg(F.sum("score")).first()[0] for t, w in (("scores", "method = 'topk'"), ("ablation_scores", "variant = 'topk'")))
    assert abs(base - capped) < 1e-9
    assert json.loads((tmp_path / "run/settings.json").read_text())["neighbours"] == 16
    with pytest.raises(ValueError):
        cli.main(["score", "--data", "x", "--output", out, "--neighbours", "3"])
