from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import evaluate as e
from logweave.operators import fusion


def test_template_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "gold string, predicted string")
    assert tuple(e.template_metrics(df, seconds=2.0).first()) == (2, 1.0, 1.0, 1.0, 1.0, 1.0)
    swapped = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "gold string, predicted string")
    r = e.template_metrics(swapped).first()
    assert (r.grouping_accuracy, r.template_f1, r.eps) == (0.0, pytest.approx(2 / 3), 0.0)
    assert e.template_metrics(df.limit(0)).first().template_f1 == 0.0


def test_scoring_takes_the_last_of_repeated_ids(spark):
    p = spark.createDataFrame([("a", 0.9, 1), ("a", 0.1, 2), ("b", 0.5, 1), ("x", 0.5, 1)], "record_id string, score double, n int")
    y = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "record_id string, label int, n int")
    r = e.score_labels(p, y, order=["n"]).first()
    assert tuple(r) == (2, 0.5, 2)
    with pytest.raises(Exception, match="no id in common"):
        e.score_labels(p, y.limit(0)).collect()


def test_threshold_and_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.3, 1), (0.1, 0)], "score double, label int")
    assert e.fit_threshold(df, "cam").first().threshold == 0.3
    assert e.fit_threshold(df.where("label = 0"), "cam").first().threshold == 1.0
    for source in ("AIT_lds", "my_ait"):
        with pytest.raises(ValueError, match="may be fitted"):
            e.fit_threshold(df, source)
    z = spark.createDataFrame([(0.0, 0), (2.0, 0), (5.0, 1)], "logit double, label int")
    p = [0.5, 1 / (1 + math.exp(-2))]
    assert e.fit_calibration(z, "my_ait", exact=True).first().threshold == pytest.approx(p[0] + 0.995 * (p[1] - p[0]))
    assert e.fit_calibration(z, "my_ait").first().threshold == pytest.approx(p[1])  # a rank of the sketch
    assert e.fit_calibration(z.where("label = 1"), "cam").first().threshold == 0.5
    with pytest.raises(ValueError, match="may be fitted"):
        e.fit_calibration(z, "ait_ads")


def test_losses(spark, rows):
    df = spark.createDataFrame([("b", 1.0, 1), ("b", 0.0, 0), ("b", 0.0, 0), ("c", 1.0, 1)], "batch string, fused_logit double, label int")
    assert rows(e.pairwise_ranking(df, batch="batch")) == [("b", pytest.approx(math.log(2))), ("c", 0.0)]
    v = spark.createDataFrame([([1.0, 3.0], 1), ([0.0, 0.0], -100)], "logits array<double>, target int").withColumn("action_logits", F.col("logits"))
    assert e.mean_slot_nll(v).first()[0] == pytest.approx(math.log(1 + math.exp(-2)))
    assert e.inverse_margin(v, [(0, 1)]).first()[0] == pytest.approx((3 + 1) / 2) and e.inverse_margin(v, []).first()[0] == 0.0
    assert e.cosine_contrast(v.where("target = 1"), "logits", "logits").first()[0] == pytest.approx(0.0)
    m = spark.createDataFrame([("loss", 1.0), ("loss", 3.0)], "metric string, value double")
    assert rows(e.mean_metrics(m)) == [("loss", 2.0)]
    s = spark.createDataFrame([(3.0, 1), (2.0, 0), (1.0, 1)], "score double, label int")
    assert [r.recall for r in e.alert_curve(s, [1, 3]).orderBy("budget").collect()] == [0.5, 1.0]


def test_fusion_learns(spark):
    rows = [(str(i), [float(i % 2), 1.0], 0.1, 0.2, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, event_embedding array<double>, graph_score double, long_horizon_score double, label double")
    got = fusion.apply_fusion(fusion.fit_fusion(df), df).collect()
    assert all((r.score > 0.5) == (r.label == 1) and r.fused_logit == pytest.approx(math.log(r.score / (1 - r.score))) for r in got)
    links = spark.createDataFrame([(float(i % 2), 0.0, 0.0, 0.0, 0.0, 60.0, float(i % 2)) for i in range(20)], "anchor_score double, stable_rarity double, action_compatibility double, path_coherence double, graph_cosine double, delta_seconds double, label double")
    x = fusion.link_inputs(links, F.array(F.lit(1.0)), F.array(F.lit(2.0)))
    assert all((r.score > 0.5) == (r.label == 1) for r in fusion.apply_link_scores(fusion.fit_link_scores(x), x).collect())
    w = fusion.weighted_fusion(spark.createDataFrame([(1.0, 0.0)], "a double, b double"), {"a": 3, "b": 1})
    assert w.first().score == 0.75


def _newton(x, y, ridge):
    """Logistic regression with intercept, the penalty on standardized weights, as logits of the rows."""
    scale = x.std(axis=0, ddof=1)
    live = scale > 0
    a = np.hstack([x[:, live] / scale[live], np.ones((len(x), 1))])
    penalty, w = np.append(np.full(live.sum(), ridge), 0.0), np.zeros(live.sum() + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (p - y) / len(y) + penalty * w
        w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a / len(y) + np.diag(penalty), grad)
    return a @ w


def test_fusion_equals_a_plain_fit_row_by_row(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(300, 4))
    g, m = rng.random(300), rng.random(300)
    y = (e[:, 0] + g - m + rng.normal(size=300) > 0.2).astype(float)
    df = spark.createDataFrame([(str(i), e[i].tolist(), float(g[i]), float(m[i]), float(y[i])) for i in range(300)], "record_id string, event_embedding array<double>, graph_score double, long_horizon_score double, label double")
    got = {int(r.record_id): r for r in fusion.apply_fusion(fusion.fit_fusion(df, rounds=200), df).collect()}
    event = _newton(e, y, 0.01)
    micro = _newton(np.hstack([e, g[:, None]]), y, 0.01)
    macro = _newton(np.hstack([e, g[:, None], m[:, None]]), y, 0.01)
    for name, want in (("event_logit", event), ("micro_logit", micro), ("macro_logit", macro)):
        assert np.abs(np.array([got[i][name] for i in range(300)]) - want).max() < 1e-3
    # Spark's heads feed the last one both the -logit and the logit of each: the same fit, with the penalty shared by two weights
    both = np.hstack([v for x in (event, micro, macro) for v in (-x[:, None], x[:, None])])
    fused = _newton(both, y, 0.01)
    assert np.abs(np.array([got[i]["fused_logit"] for i in range(300)]) - fused).max() < 1e-2
    assert all(abs(got[i].score - 1 / (1 + math.exp(-got[i].fused_logit))) < 1e-12 for i in range(300))
