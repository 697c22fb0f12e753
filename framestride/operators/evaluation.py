"""Evaluation metrics, experiment results and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.functions.geometry import lit
from framestride.operators.skew import exact_quantiles


def horizon_weights(horizon: int, mode: str = "uniform", beta: float = 0.1) -> Column:
    """Weights of the steps, summing to one (F32)."""
    k = F.sequence(F.lit(1), F.lit(horizon))
    if mode == "linear":
        raw = F.transform(k, lambda i: (horizon + 1 - i).cast("double"))
    elif mode == "exp":
        raw = F.transform(k, lambda i: F.exp(lit(-beta) * (i - 1)))
    else:
        raw = F.transform(k, lambda i: lit(1))
    return G.let(raw, lambda w: F.transform(w, lambda x: x / F.aggregate(w, lit(0), lambda a, b: a + b)))


def step_errors(predictions: DataFrame, std=(1.0, 1.0, 1.0)) -> DataFrame:
    """Physical position error and rotation error of each prediction."""
    p, q = G.vec("pos_pred"), G.vec("pos_true")
    out = predictions.withColumn("pos_err", G.norm([(a - b) * lit(s) for a, b, s in zip(p, q, std)]))
    if {"o6d_pred", "o6d_true"} <= set(predictions.columns):
        out = out.withColumns({"_a": F.array(*G.decode_6d("o6d_pred", 0.0)), "_b": F.array(*G.decode_6d("o6d_true", 0.0))})
        out = out.withColumn("rot_err", G.rotation_angle("_a", "_b", 0.999999)).drop("_a", "_b")
    return out


def horizon_by_step(errors: DataFrame) -> DataFrame:
    """Errors per step as the mean over batches of batch means, and grasp counts."""
    pred, true = F.col("g_prob") >= 0.5, F.col("g_true") >= 0.5
    done = (F.col("done_prob") > 0.5) == (F.col("done_true") > 0.5)
    per_batch = errors.groupBy("batch_id", "k").agg(
        F.avg("pos_err").alias("pos"),
        F.avg("rot_err").alias("rot"),
        F.count_if(pred & true).alias("tp"),
        F.count_if(pred & ~true).alias("fp"),
        F.count_if(~pred & true).alias("fn"),
        F.count_if(done).alias("done"),
        F.count(F.lit(1)).alias("n"),
    )
    by_step = per_batch.groupBy("k").agg(
        F.avg("pos").alias("pos_err"),
        F.avg("rot").alias("rot_err"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "done", "n")],
    )
    precision = F.col("tp") / F.greatest(lit(1), F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(lit(1), F.col("tp") + F.col("fn"))
    f1 = 2 * precision * recall / F.greatest(lit(1e-8), precision + recall)
    return by_step.withColumn("f1", f1)


def row_weighted_by_step(errors: DataFrame) -> DataFrame:
    """Errors per step as plain means over the rows, for comparison with the batch means."""
    return errors.groupBy("k").agg(F.avg("pos_err").alias("pos_err"), F.avg("rot_err").alias("rot_err"))


def horizon_metrics(by_step: DataFrame, horizon: int, mode: str = "uniform", beta: float = 0.1) -> DataFrame:
    """Errors at the first and last step and weighted over the horizon, done accuracy."""
    w = F.get(horizon_weights(horizon, mode, beta), F.col("k") - 1)
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return by_step.agg(
        F.max("n").alias("frames"),
        (F.sum("done") / F.greatest(F.lit(1), F.sum("n"))).alias("done_acc"),
        at("pos_err", 1).alias("pos_err_k1_m"),
        at("pos_err", horizon).alias("pos_err_kK_m"),
        at("rot_err", 1).alias("rot_err_k1_deg"),
        at("rot_err", horizon).alias("rot_err_kK_deg"),
        F.sum(F.col("pos_err") * w).alias("pos_err_w_m"),
        F.sum(F.col("rot_err") * w).alias("rot_err_w_deg"),
        at("f1", 1).alias("grasp_f1_k1"),
        at("f1", horizon).alias("grasp_f1_kK"),
        F.sum(F.col("f1") * w).alias("grasp_f1_w"),
    )


def finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != lit(float("inf")))
    return ok


def score(pos: Column, rot: Column, f1: Column) -> Column:
    """Fixed score, null when an input is not finite."""
    return F.when(finite(pos, rot, f1), pos + rot / 100.0 - f1 * 0.10)


def repeat_summary(rows: DataFrame, metrics: list[str], by: str = "steps") -> DataFrame:
    """Mean, sample deviation (0 for one row), min and max per group and metric.

    Groups with a value that is not finite get ``finite = false`` and no figures.
    """
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(by, "m.*")
    out = long.groupBy(by, "metric").agg(
        F.count(F.lit(1)).alias("runs"),
        F.bool_and(finite(F.col("value"))).alias("finite"),
        F.avg("value").alias("mean"),
        F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp("value")), lit(0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return out.withColumns({c: F.when(F.col("finite"), F.col(c)) for c in ("mean", "std", "min", "max")})


REQUIRED = ("pos_err_w_m", "rot_err_w_deg", "grasp_f1_w")


def experiment_results(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest snapshot of each run by file name, its status and score.

    ``runs`` lists the experiments; ``snapshots`` has ``experiment_id``, ``file_name``, ``ok`` (parsed)
    and the metrics as strings, null where the key is missing.
    """
    last = snapshots.groupBy("experiment_id").agg(
        F.max_by(F.struct("file_name", "ok", *REQUIRED), "file_name").alias("s")
    )
    rows = runs.select("experiment_id").join(last, "experiment_id", "left")
    raw = [F.col(f"s.{c}") for c in REQUIRED]
    values = [c.try_cast("double") for c in raw]
    missing = raw[0].isNull() | raw[1].isNull() | raw[2].isNull()
    broken = values[0].isNull() | values[1].isNull() | values[2].isNull()
    status = (
        F.when(F.col("s").isNull(), "EVAL_MISSING")
        .when(~F.col("s.ok") | missing | broken, "EVAL_ERROR")
        .when(~finite(*values), "NAN")
        .otherwise("SUCCESS")
    )
    good = F.col("status") == "SUCCESS"
    return (
        rows.withColumn("status", status)
        .withColumn("score", F.when(good, score(*values)))
        .select("experiment_id", "status", "score", *[F.when(good, v).alias(c) for v, c in zip(values, REQUIRED)])
    )


def successful(rows: DataFrame) -> DataFrame:
    """Successful experiments with a score."""
    return rows.where((F.col("status") == "SUCCESS") & F.col("score").isNotNull() & (F.col("score").cast("string") != ""))


def leaderboard(rows: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Successful experiments ranked by ascending score.

    The rank is the row number of a global sort: ranges of scores are numbered in parallel and
    shifted by the size of the ranges before them.
    """
    good = successful(rows).withColumn("score", F.col("score").cast("double"))
    coarse = F.floor(F.col("score") * 1000)
    good = good.withColumn("_range", coarse)
    sizes = good.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_range", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy("score", key))
    return (
        good.withColumn("_in", inner)
        .join(offsets, "_range")
        .withColumn("rank", (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_range", "_in", "_before")
    )


# --- report tables ---------------------------------------------------------------------------------------


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts per bin; min(40, max(10, floor(sqrt(n)))) bins over the value range, last bin closed."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    bins = F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt(F.count(F.lit(1)))))).cast("int")
    span = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), bins.alias("bins")).alias("s")).scalar()
    joined = rows.withColumn("_s", span).select("v", "_s.*")
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width * F.col("bins"))).otherwise(F.lit(0))
    return joined.groupBy(F.least(b, F.col("bins") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def box_plot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles per entity."""
    return exact_quantiles(df, [key], value, [0.25, 0.5, 0.75], ["q1", "q2", "q3"])


def longest_episodes(summary: DataFrame, n: int = 30) -> DataFrame:
    """Recordings with the most frames."""
    return summary.orderBy(F.desc("frames"), "episode").limit(n)


def worst_episodes(summary: DataFrame, n: int = 20) -> DataFrame:
    """Recordings by errors, then warnings."""
    return summary.orderBy(F.desc("errors"), F.desc("warnings"), "episode").limit(n)


def first_issues(issues: DataFrame, n: int = 80) -> DataFrame:
    """The first errors and warnings of the report."""
    bad = issues.where(F.col("severity").isin("error", "warning"))
    return bad.orderBy("episode", "frame", "metric", "severity").limit(n)


def report_cards(summary: DataFrame, score_: DataFrame) -> DataFrame:
    """One row with the figures at the top of the report."""
    totals = summary.agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.sum(c).alias(c) for c in ("frames", "errors", "warnings", "infos")],
    )
    return totals.crossJoin(F.broadcast(score_))  # one row on each side
