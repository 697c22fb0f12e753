"""Writers of result tables (K01 to K09). Parquet is the native form, CSV and JSON the exchange forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.operators import audit as A
from framestride.operators import evaluation as E
from framestride.operators import phases as P
from framestride.operators import sync as Y
from framestride.session import stage


def _flat(df: DataFrame) -> DataFrame:
    """Without matrix, vector and map columns."""
    nested = ("array", "map", "struct")
    return df.select(*[f.name for f in df.schema.fields if not f.dataType.typeName().startswith(nested)])


def write_csv(df: DataFrame, path: str) -> None:
    _flat(df).write.mode("overwrite").option("header", "true").csv(path)


def audit_summary(issues: DataFrame, frames: DataFrame, cfg: dict | None = None, notes: str = "") -> DataFrame:
    """One row: counts by severity and category, score, parts, configuration and notes."""
    from framestride.config import audit_config
    import json

    pairs = lambda c: issues.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(c), F.col("n")))).alias(f"by_{c}")
    )
    # Severities and categories are fixed short lists.
    parts = A.score_parts(issues, frames, cfg).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "part"))).alias("parts")
    )
    return (
        pairs("severity")
        .crossJoin(pairs("category"))
        .crossJoin(A.quality_score(issues, frames, cfg))
        .crossJoin(parts)
        .withColumn("config", F.lit(json.dumps(audit_config(cfg))))
        .withColumn("notes", F.lit(notes))
    )


def write_audit(result, path: str, cfg: dict | None = None, csv: bool = True) -> None:
    """Frame metrics, issues, episode metrics and the summary of an audit.

    Issues and frames are staged first: every later table is derived from the staged ones.
    """
    issues, frames = stage(result.issues), stage(result.frames)
    issues.write.mode("overwrite").partitionBy("severity").parquet(f"{path}/issues")
    frames.write.mode("overwrite").parquet(f"{path}/frames")
    episodes = A.episode_summary(frames, issues)
    episodes.write.mode("overwrite").parquet(f"{path}/episodes")
    if csv:
        write_csv(issues, f"{path}/issues_csv")
        write_csv(frames, f"{path}/frames_csv")
        write_csv(episodes, f"{path}/episodes_csv")
    audit_summary(issues, frames, cfg).write.mode("overwrite").json(f"{path}/summary")


def write_sync(matches: DataFrame, path: str, per_ms: float = 1e6) -> None:
    """Manifest rows and the PASS/CHECK summary."""
    matches.write.mode("overwrite").json(f"{path}/sync_manifest")
    Y.sync_summary(matches, per_ms=per_ms).write.mode("overwrite").json(f"{path}/sync_summary")


def write_phases(phases: DataFrame, path: str) -> None:
    """Phase rows, windows and counts."""
    rows = stage(phases)
    rows.write.mode("overwrite").parquet(f"{path}/phases")
    P.phase_windows(rows).write.mode("overwrite").parquet(f"{path}/windows")
    P.mode_counts(rows).write.mode("overwrite").parquet(f"{path}/counts")


def write_import(matches: DataFrame, path: str, keep_outliers: bool = False) -> None:
    """Manifest with the output index of every kept frame."""
    Y.manifest(matches, keep_outliers).write.mode("overwrite").json(f"{path}/manifest")


def write_repeats(rows: DataFrame, metrics: list[str], path: str, by: str = "steps") -> None:
    """Raw rows and their summary per step count."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    E.repeat_summary(rows, metrics, by).write.mode("overwrite").parquet(f"{path}/summary")
