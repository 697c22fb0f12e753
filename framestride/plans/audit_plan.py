"""The dataset audit end to end: frames in, issues, episode summary and score out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from framestride.functions.issues import explode_checks, union_issues
from framestride.operators import audit as A
from framestride.operators import series as S
from framestride.operators.objects import adapter_issues


@dataclass
class Audit:
    """Lazy result tables of one audit."""

    frames: DataFrame
    motion: DataFrame
    issues: DataFrame

    def episodes(self) -> DataFrame:
        return A.episode_summary(self.frames, self.issues)

    def speeds(self) -> DataFrame:
        return A.speed_percentiles(self.motion)

    def score(self, cfg: dict | None = None) -> DataFrame:
        return A.quality_score(self.issues, self.frames, cfg)


def audit(
    training: DataFrame, cfg: dict | None = None, ts: str = "ts", listed: DataFrame | None = None, adapter: DataFrame | None = None
) -> Audit:
    """Audit a training table with the columns of ``FIXTURES.md``; every check whose columns are there is run.

    Optional columns: the image metrics, ``image_path``, ``image_read_ok``, ``image_w``, ``image_h``, mask coverages
    (``mask_*_coverage``), ``dhash``, and ``split`` with ``appearance``. ``listed`` has the frames that should have a record,
    ``adapter`` the points of a user function per frame. Frame checks and entity checks are each one pass: all checks of
    a row are one array.
    """
    masks = sorted(c for c in training.columns if c.startswith("mask_") and c.endswith("_coverage"))
    hashed = "dhash" in training.columns
    frames = A.temporal_metrics(A.flatten_frames(training), ts)
    checks = A.temporal_checks(cfg) + A.record_checks(frames.columns) + A.image_checks(frames.columns, cfg)
    scans = A.previous_masks(masks) + ([A.previous_hash()] if hashed else [])
    if scans:
        frames = S.scan(frames, ["episode"], "frame_idx", scans)
        checks += A.mask_checks(masks, cfg) + A.mask_jump_checks(masks, cfg)
    if hashed:
        frames = A.with_hash_distance(frames, cfg=cfg)
        checks += A.near_duplicate_checks(cfg)
    motion = A.with_se3(A.entity_motion(A.entity_poses(frames, ["pos", "ts_s"])))
    parts = [
        explode_checks(frames, checks),
        explode_checks(motion, A.se3_checks(cfg) + A.motion_checks(cfg)),
        A.label_issues(training, A.entity_poses(training)),
    ]
    if hashed:
        parts.append(A.duplicate_issues(training))
    if {"split", "appearance"} <= set(training.columns):
        parts.append(A.distribution_issues(A.distribution_shift(training, cfg=cfg)))
    if listed is not None:
        parts.append(A.missing_record_issues(listed, training))
    if adapter is not None:
        parts.append(adapter_issues(adapter))
    issues = union_issues(parts)
    return Audit(frames, motion, issues)
