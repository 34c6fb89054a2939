"""Exact score curves, metrics and threshold selection.

Rows are aggregated to one row per distinct score before anything is ordered,
and the ordered pass is a scan over range partitions (``ordered_scan``), so a
curve over any number of distinct scores is computed by many tasks, exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered_scan import prefix_sums

def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score with counts of rows scoring at least that much."""
    groups = (
        df.select(F.col(score).cast("double").alias("threshold"), F.col(label).cast("int").alias("y"))
        .groupBy("threshold")
        .agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    )
    run = prefix_sums(groups, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}, grand=("tp", "fp"))
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("tp_all"), F.col("fp_all")
    precision = tp / (tp + fp)
    recall = F.when(p > 0, tp / p).otherwise(F.lit(1.0))
    return run.select(
        "threshold", "pos", "neg", "tp", "fp",
        p.alias("n_pos"), n.alias("n_neg"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(n > 0, fp / n).alias("fpr"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
        .otherwise(F.lit(0.0)).alias("f1"),
    )


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    return score_curve(df, label, score).select("threshold", "precision", "recall")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    return score_curve(df, label, score).select("threshold", "fpr", F.col("recall").alias("tpr"))


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc_roc (rank form, ties counted half) and auc_pr (average precision).

    Both are null unless both classes occur.
    """
    c = score_curve(df, label, score)
    p, n = F.max("n_pos"), F.max("n_neg")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.when(F.col("n_pos") > 0, F.col("pos") / F.col("n_pos") * F.col("precision")))
    both = (p > 0) & (n > 0)
    return c.agg(
        F.when(both, wins / (p.cast("double") * n)).alias("auc_roc"),
        F.when(both, steps).alias("auc_pr"),
    )


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1; 0 where undefined."""
    y, z = F.col(label).cast("int"), F.col(predicted).cast("int")
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (z == 1)).alias("tp"),
        F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"),
        F.count_if(y == z).alias("right"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0).alias("accuracy"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
    )


def evaluate(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """All metrics of a scored table at a threshold, as (metric, value) rows."""
    flagged = df.withColumn("__pred", (F.col(score) >= F.lit(threshold)).cast("int"))
    basic = classification_metrics(flagged, label, "__pred")
    ranks = ranking_metrics(df, label, score)
    long = lambda d: d.unpivot([], d.columns, "metric", "value")
    return long(basic).unionByName(long(ranks)).where(F.col("value").isNotNull())


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


# -- thresholds ------------------------------------------------------------------

def _best_f1():
    return F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))


def threshold_by_recall(df: DataFrame, label: str, score: str, target: float = 0.95) -> DataFrame:
    """Highest threshold whose recall reaches the target, else 0.5."""
    c = score_curve(df, label, score)
    best = F.max(F.when(F.col("recall") >= target, F.col("threshold")))
    return c.agg(F.coalesce(best, F.lit(0.5)).alias("threshold"))


def threshold_f1_max(df: DataFrame, label: str, score: str) -> DataFrame:
    """Threshold of the best F1 (lowest of equals), else 0.5."""
    return score_curve(df, label, score).agg(F.coalesce(_best_f1(), F.lit(0.5)).alias("threshold"))


def threshold_precision_floor(df: DataFrame, label: str, score: str, floor: float = 0.10) -> DataFrame:
    """Lowest threshold whose precision reaches the floor, else the best F1."""
    lowest = F.min(F.when(F.col("precision") >= floor, F.col("threshold")))
    return score_curve(df, label, score).agg(
        F.coalesce(lowest, _best_f1(), F.lit(0.5)).alias("threshold")
    )


def threshold_f1_with_floor(df: DataFrame, label: str, score: str, floor: float = 0.05) -> DataFrame:
    """Best F1, unless its precision is below the floor; then the precision floor rule."""
    c = score_curve(df, label, score)
    best_precision = F.max_by("precision", F.struct(F.col("f1"), -F.col("threshold")))
    lowest = F.min(F.when(F.col("precision") >= floor, F.col("threshold")))
    return c.agg(
        F.when(best_precision >= floor, _best_f1())
        .otherwise(F.coalesce(lowest, _best_f1(), F.lit(0.5))).alias("threshold")
    )


STRATEGIES = {
    "f1_with_floor": lambda d, y, s, recall, floor: threshold_f1_with_floor(d, y, s, floor),
    "f1_max": lambda d, y, s, recall, floor: threshold_f1_max(d, y, s),
    "precision_floor": lambda d, y, s, recall, floor: threshold_precision_floor(d, y, s, floor),
    "recall_target": lambda d, y, s, recall, floor: threshold_by_recall(d, y, s, recall),
}


def optimize_threshold(
    df: DataFrame, label: str, score: str, strategy: str = "f1_with_floor",
    target_recall: float = 0.85, min_precision: float = 0.05,
) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](df, label, score, target_recall, min_precision)


# -- percentiles -------------------------------------------------------------------

def exact_percentile(df: DataFrame, col: str, fraction: float, name: str = "percentile") -> DataFrame:
    """Percentile with linear interpolation between the two nearest ranks.

    Ranks come from counts per distinct value, so the values are never held by
    one task (the built-in exact percentile keeps them all in one buffer).
    """
    groups = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    )
    run = prefix_sums(groups, [F.asc("v")], {"upto": F.col("n")}, grand=("upto",))
    pos = F.lit(fraction) * (F.col("upto_all") - 1)
    return (
        run.agg(
            F.min(F.when(F.col("upto") > F.floor(pos), F.col("v"))).alias("lo"),
            F.min(F.when(F.col("upto") > F.ceil(pos), F.col("v"))).alias("hi"),
            F.max(pos - F.floor(pos)).alias("w"),
        )
        .select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias(name))
    )
