"""What the training job keeps on disk and in memory."""

import dataclasses
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import models as Mo
from fleetlens.operators.splits import split_by_positives
from fleetlens.plans import training as Tr
from fleetlens.session import scratch_path, stored
from fleetlens.sources import tables as Tb

CFG = dataclasses.replace(Tr.JobConfig(), max_iter=3, max_depth=2)


def labelled(spark, n=600):
    k = F.col("id")
    return stored(spark.range(n).select(
        k.alias("event_id"), F.timestamp_seconds(1_704_067_200 + k * 60).alias("timestamp"), (k % 17).cast("double").alias("a"),
        (k % 29).cast("double").alias("b"), (k % 5 == 0).alias("is_pre_failure")), scratch_path(spark, "labelled"))


def test_features_are_kept_once(spark, monkeypatch):
    """Once the split features are written, those without a split go; nothing is made again the next time."""
    raw, root = labelled(spark), scratch_path(spark, "jobs")
    monkeypatch.setattr(Tr, "kpi_stage", lambda raw, path: raw)
    monkeypatch.setattr(Tr, "feature_matrix", lambda kpi, *a, **k: kpi)
    stamp, _, split = Tr.split_stage(raw, root, CFG)
    want = {tuple(r) for r in split_by_positives(raw).collect()}
    assert {tuple(r) for r in split.collect()} == want and {r[-1] for r in want} == {"train", "val", "test"}
    assert not Tb.path_exists(spark, Tb.features_path(root, stamp)) and Tb.path_exists(spark, f"{root}/split/source={stamp}/_SUCCESS")
    monkeypatch.setattr(Tr, "feature_matrix", lambda *a, **k: pytest.fail("made again"))
    _, _, again = Tr.split_stage(raw, root, CFG)
    assert {tuple(r) for r in again.collect()} == want


def test_rows_of_cleaning_are_removed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Tr, "preprocess", lambda df: seen.extend(df.inputFiles()) or df)
    monkeypatch.setattr(Tr, "with_true_efficiency", lambda df: df)
    raw = labelled(spark, 40).withColumn("miner_id", F.lit("d"))
    kpi = Tr.kpi_stage(raw, scratch_path(spark, "kpi"))
    assert kpi.count() == 40 and seen and not any(Tb.path_exists(spark, f) for f in seen)


def test_large_fits_read_their_rows_again(spark, monkeypatch):
    """Rows of a fit are kept beside its binned rows only while they are few for the cores; the model is the same."""
    assert Mo.fits_in_memory(2_111_990, 136, 12) and not Mo.fits_in_memory(20_000_000, 136, 12)
    seen, fit = [], Mo.GBTClassifier.fit
    monkeypatch.setattr(Mo.GBTClassifier, "fit", lambda self, rows: seen.append(rows.storageLevel.useMemory) or fit(self, rows))
    rows = labelled(spark)
    small = Mo.FailureClassifier.fit(rows, ["a", "b"], max_iter=3, max_depth=2)
    monkeypatch.setattr(Mo, "BYTES_A_TASK", 1)
    monkeypatch.setattr(Mo, "fit_tasks", lambda rows, *size: max(Mo.LEAST_TASKS, size[1]))
    large = Mo.FailureClassifier.fit(rows, ["a", "b"], max_iter=3, max_depth=2)
    assert seen == [True, False]
    a, b = (m.score(rows).orderBy("event_id").collect() for m in (small, large))
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_finished_shuffles_are_dropped(spark, monkeypatch):
    """A kept table leaves no shuffle files behind, however seldom the driver collects garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before, made, write = files(), set(), Tb.write_parquet
    monkeypatch.setattr(Tb, "write_parquet", lambda *a, **k: write(*a, **k) and made.update(files() - before))
    kept = Tb.built_once(spark, scratch_path(spark, "kept"), lambda: spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count())
    assert made
    until = time.time() + 20
    while made & files() and time.time() < until:
        time.sleep(0.2)
    assert not made & files() and kept.count() == 7000
