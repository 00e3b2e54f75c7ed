from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweave.operators import governance as g


def entry(**other):
    base = {"dataset_id": "a", "display_name": "A", "role": "source", "tier": "t", "official_url": "u", "status": "ready", "allowed_label_usage": "x", "prohibited_usage": "p"}
    return base | other


def test_registry(spark, rows, tmp_path):
    df = spark.createDataFrame([entry(), entry(dataset_id="b", display_name=None, status="lost"), entry(dataset_id="c", role="target_test")], schema=", ".join(f"{k} string" for k in entry()))
    assert rows(g.registry_violations(df)) == [("b", "invalid status lost"), ("b", "missing fields display_name"), ("c", "target label usage must be evaluation_only_p1")]
    assert g.registry_violations(df.drop("tier")).where("violation like '%tier%'").count() == 3
    df.limit(1).write.json(str(tmp_path / "ok"))
    assert g.read_registry(spark, str(tmp_path / "ok")).count() == 1
    df.write.json(str(tmp_path / "bad"))
    with pytest.raises(g.Violation, match="registry"):
        g.read_registry(spark, str(tmp_path / "bad"))


def release(tmp_path, *names):
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    return str(tmp_path)


def test_lock_seal_and_tamper(spark, rows, tmp_path):
    with pytest.raises(g.Violation, match="release lacks"):
        g.lock_release(spark, release(tmp_path, *g.RELEASE_INPUTS))
    root = release(tmp_path, "checkpoints/a.pt")
    locked = g.lock_release(spark, root)
    assert locked.count() == 5
    with pytest.raises(g.Violation, match="isn't locked"):
        g.seal(locked, locked, "r")
    files = g.file_hashes(spark, release(tmp_path, "RELEASE_LOCKED"))
    sealed = g.seal(files.where("path like '%.json'"), files, "r1")
    assert g.tampered(sealed, files).count() == 0
    changed = files.where("path not like '%thresholds%'").withColumn("sha256", F.when(F.col("path").like("%calibration%"), "x").otherwise(F.col("sha256")))
    assert [r[1] for r in rows(g.tampered(sealed, changed))] == ["changed", "missing"]
    assert g.tampered(sealed.withColumn("status", F.lit("OPEN")), files).where("reason = 'not_sealed'").count() == 4


def test_release_selection(spark, rows):
    df = spark.createDataFrame([entry(), entry(dataset_id="b", tier="target"), entry(dataset_id="c"), entry(dataset_id="d")], schema=", ".join(f"{k} string" for k in entry()))
    assert rows(g.release_selection(df, excluded=("c",), strict_excluded=("d",)), "dataset_id") == [("a",)]
    assert rows(g.release_selection(df, variant="enhanced", excluded=("c",), strict_excluded=("d",)), "dataset_id") == [("a",), ("d",)]


def test_state_log(spark, rows):
    log = spark.createDataFrame([("r", 1, "SOURCE_FROZEN"), ("r", 2, "TARGET_INFERENCE_STARTED"), ("q", 1, "RELEASE_LOCKED")], "release string, t int, state string")
    assert rows(g.illegal_transitions(log, "release", "state", ["t"]), "release", "previous", "state") == [("q", "DEVELOPMENT", "RELEASE_LOCKED"), ("r", "SOURCE_FROZEN", "TARGET_INFERENCE_STARTED")]


def test_run_summary(spark, rows):
    m = spark.createDataFrame([("a", "in", "h0", "x", "h1", 3, 2, 1), ("b", "x", "h1", "y", "h2", 2, 2, 0), ("c", "y", "old", "z", "h3", 2, 2, 0)], "stage string, input_path string, input_sha256 string, output_path string, output_sha256 string, input_count int, output_count int, rejected_count int")
    assert rows(g.run_summary(m), "stage", "upstream_unchanged") == [("a", True), ("b", True), ("c", False)]
