"""Mixing: very long documents, inclusion frequencies, fixed sizes, strata and weights."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm.mixing import UNIT, mix_sources, stratum

KIND = "doc_id long, text string, source string"


@pytest.mark.parametrize("seed", [0, 1])
def test_one_very_long_document_blocks_nothing(spark, seed):
    rows = [(0, "w " * 20_000, "a"), *[(i, "w " * 250, "a") for i in range(1, 41)]]
    got = mix_sources(spark.createDataFrame(rows, KIND), share=0.3, seed=seed).collect()
    assert sum(r.taken for r in got) == got[0].target == 9000


def test_very_long_texts_come_near_the_target(spark):
    rows = [(i, "w " * (150_000 + 999 * i), "a") for i in range(6)] + [(100 + i, "w " * (50 + i % 300), "a") for i in range(900)]
    got = mix_sources(spark.createDataFrame(rows, KIND), share=0.7).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) < 0.01 * got[0].target


def test_documents_are_taken_as_often_as_their_odds_say(spark):
    """Over many equal sources, frequencies are the inclusion probabilities, which differ by document; each sample has a fixed size."""
    rows = [(1000 * k + i, "w " * 64, f"s{k:02d}", float(1 + i % 4)) for k in range(60) for i in range(200)]
    df = spark.createDataFrame(rows, KIND + ", weight double")
    got = mix_sources(df, weights=(1,), share=0.3, weight=F.col("weight"), carry=["doc_id"]).select("doc_id", "copies").collect()
    samples = defaultdict(set)
    for r in got:
        samples[r.doc_id // 1000] |= {r.doc_id % 1000} if r.copies else set()
    assert {len(s) for s in samples.values()} == {60} and len(set(map(frozenset, samples.values()))) == 60
    for w in range(4):  # expected copies are 0.3 * weight / mean weight
        assert sum(i % 4 == w for s in samples.values() for i in s) / 3000 == pytest.approx(0.3 * (w + 1) / 2.5, abs=0.03)


def test_certain_copies_and_chances_by_weight(spark):
    """With weights 1 and 8 and room for one and a half copies, the heavy have all they may, the light the rest."""
    rows = [(i, "w " * 10, "a", 8.0 if i < 20 else 1.0) for i in range(100)]
    got = mix_sources(spark.createDataFrame(rows, KIND + ", weight double"), share=1.5, weight=F.col("weight")).collect()
    assert {r.copies for r in got if r.doc_id < 20} == {2} and Counter(r.copies for r in got if r.doc_id >= 20) == {1: 50, 2: 30}


def test_shorter_documents_have_higher_odds_by_default(spark):
    rows = [(i, "w " * (16 if i % 2 else 256), "a") for i in range(400)]
    got = mix_sources(spark.createDataFrame(rows, KIND), share=0.4).collect()
    short, long = (sum(r.copies for r in got if r.doc_id % 2 == k) / 200 for k in (1, 0))
    assert short / long == pytest.approx(2, rel=0.1)


def test_the_cut_is_that_of_a_sorted_order(spark):
    """A stratum cut in bins of bins takes what a sort by rank would take."""
    rows = [(i, "w " * 40, "a") for i in range(5000)]
    df = spark.createDataFrame(rows, KIND)
    got = mix_sources(df, share=0.33, seed=5).collect()
    from logweave.llm.mixing import random_unit

    order = [r.doc_id for r in df.select("doc_id", random_unit(5, "doc_id", "text").alias("u")).orderBy("u").collect()]
    assert {r.doc_id for r in got if r.copies} == set(order[:1650])


def test_strata_are_octaves_cut_in_eight(spark):
    sizes = [0, 1, 2, 3, 4, 7, 8, 15, 16, 17, 18, 255, 256, 287, 288, UNIT]
    got = [r.s for r in spark.createDataFrame([(s,) for s in sizes], "n long").select(stratum(F.col("n")).alias("s")).collect()]
    assert got == sorted(got) and got[0] == 0
    assert got[8] == got[9] != got[10] and got[12] == got[13] != got[14]


def test_repeated_rows_share_their_fate_and_clashing_names_go(spark):
    rows = [(i % 50, "w " * 12, "a", "own") for i in range(100)]
    out = mix_sources(spark.createDataFrame(rows, KIND + ", copies string"), share=0.5)
    got = defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add(r.copies)
    assert all(len(c) == 1 for c in got.values()) and dict(out.dtypes)["copies"] == "bigint"
