"""Writers on the smallest surrogate data."""

import json

from framestride.plans.audit_plan import audit
from framestride.plans.surrogate import training
from framestride.session import drop_stages
from framestride.sources import sinks
from tests.conftest import SF


def test_audit_is_written(spark, tmp_path):
    out = str(tmp_path / "audit")
    sinks.write_audit(audit(training(spark, SF)), out)
    drop_stages(spark)
    assert spark.read.parquet(f"{out}/issues").count() == spark.read.option("header", "true").csv(f"{out}/issues_csv").count()
    assert spark.read.parquet(f"{out}/episodes").count() == 15
    summary = spark.read.text(f"{out}/summary").first()[0]
    row = json.loads(summary)
    assert 0 <= row["score"] <= 100 and row["by_severity"]["error"] > 0
