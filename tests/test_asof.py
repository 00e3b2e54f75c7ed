from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import evaluate
from logweave.operators.asof import as_of, detection_delays, false_alert_rate
from logweave.operators.links import link_quality, time_adjacent_links


def test_as_of_equals_brute_force_over_ranges(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(60)])) for i in range(300)]
    right = [(i, rng.choice("ab"), rng.choice([None, *range(0, 60, 7)])) for i in range(40)]
    got = as_of(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "j long, k string, t long"), "t", ["k"])
    assert got.count() == 300
    for r in got.collect():
        want = max((x[2] for x in right if x[1] == r.k and x[2] is not None and r.t is not None and x[2] <= r.t), default=None)
        assert (r.last.t if r.last else None) == want and (r.last is None or r.last.k == r.k)
    alone = as_of(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame([], "j long, k string, t long"), "t")
    assert alone.where("last is not null").isEmpty() and alone.count() == 300


def test_delays_and_false_alerts(spark):
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    alerts = spark.createDataFrame([("h", at(5)), ("h", at(9)), ("h", at(130)), ("g", at(50)), ("g", at(55))], "host string, t string").select("host", F.col("t").cast("timestamp").alias("ts"))
    attacks = spark.createDataFrame([("h", at(4)), ("h", at(100)), ("h", at(125)), ("g", at(51))], "host string, t string").select("host", F.col("t").cast("timestamp").alias("ts"))
    found = {(r.host, r.start.second + 60 * r.start.minute): r.delay_seconds for r in detection_delays(alerts, attacks, 60.0, ["host"]).collect()}
    assert found == {("h", 4): 1.0, ("h", 100): None, ("h", 125): 5.0, ("g", 51): 4.0}
    assert tuple(false_alert_rate(alerts, attacks, 60.0, 2.0, ["host"]).first()) == (5, 1, 0.5)


@pytest.mark.parametrize("spread", [0.3, 5.0, 80.0])
def test_ranking_without_pairs(spark, spread):
    rng = random.Random(int(spread * 10))
    rows = [(rng.choice(["a", "b", None]), rng.gauss(0, spread), rng.randint(0, 1)) for _ in range(400)] + [("only", 1.0, 1), ("a", float("nan"), 1), ("a", None, 0)]
    got = {r.batch: r.ranking for r in evaluate.pairwise_ranking(spark.createDataFrame(rows, "b string, fused_logit double, label int"), batch="b").collect()}
    soft = lambda d: max(d, 0) + math.log1p(math.exp(-abs(d)))
    for b in ("a", "b", None):
        pos, neg = ([x for k, x, y in rows if k == b and y == side and x is not None and not math.isnan(x)] for side in (1, 0))
        want = math.fsum(soft(1 - p + n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[b] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert got["only"] == 0.0


def test_one_order_serves_all_budgets(spark):
    rows = spark.createDataFrame([(i, i / 10, i % 3 == 0) for i in range(30)], "i long, score double, y boolean").withColumn("label", F.col("y").cast("int"))
    assert [tuple(r) for r in evaluate.alert_curve(rows, [1, 3, 30, 99], ties=["i"]).orderBy("budget").collect()] == [(1, 0.0), (3, 0.1), (30, 1.0), (99, 1.0)]
    assert evaluate.alert_curve(rows.where("i < 0"), [5]).first().recall == 0.0


def test_time_neighbours_and_quality(spark):
    w = spark.range(50).select(F.format_string("w%02d", "id").alias("window_id"), (F.col("id") * F.when(F.col("id") < 40, 60).otherwise(600)).cast("timestamp").alias("window_start"))
    found = {(r.source_window, r.target_window) for r in time_adjacent_links(w.repartition(7), 100.0).collect()}
    assert found == {(f"w{i:02d}", f"w{i + 1:02d}") for i in range(39)}
    truth = w.select("window_id", (F.substring("window_id", 3, 1) < "5").alias("label"))
    q = link_quality({"t": time_adjacent_links(w, 100.0), "none": time_adjacent_links(w, -1.0)}, truth).orderBy("links").collect()
    assert (q[0].n_links, q[0].precision) == (0, None) and (q[1].n_links, q[1].n_right) == (39, 39 - 4 - 3)
