"""Vectors of two dimensions, own columns with the stages' names, and the recall of all filters of near_dedup together."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm.cap_filters import vector_groups
from logweave.llm.near_copies import RADIUS, band_keys, least_equal, set_fingerprint, shingle_set, sketch


def test_vectors_of_two_dimensions_in_one_label(spark):
    rng = np.random.default_rng(8)
    angle = rng.random(120) * 2 * np.pi
    vectors = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.uniform(0.5, 2, 120)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    got = {r.vec_id: r for r in vector_groups(df).collect()}
    assert [got[i].n_links for i in range(120)] == (near.sum(axis=1) - 1).tolist()
    reach = near
    while ((again := reach.astype(int) @ reach.astype(int) > 0) != reach).any():
        reach = again
    assert [got[i].component_id for i in range(120)] == reach.argmax(axis=1).tolist()


def test_stages_carry_own_columns_with_names_that_operators_use(spark, tmp_path):
    r = random.Random(3)
    prose = lambda: " ".join(f"{r.choice('abcd')}{r.randint(0, 999)}" for _ in range(40)) + "."
    rows = [(i, prose(), "en", "s", 1, f"c{i}", f"k{i}", i) for i in range(12)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, cleaned string, kept_text string, copies long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        assert docs.where((F.col("cleaned") != F.concat(F.lit("c"), "doc_id")) | (F.col("kept_text") != F.concat(F.lit("k"), "doc_id")) | (F.col("copies") != F.col("doc_id"))).isEmpty()


def test_bands_radius_and_sketch_together_lose_next_to_nothing():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    equal, found, pairs = least_equal(0.8), 0, 0
    while pairs < 300:
        a = [rng.choice(words) for _ in range(rng.randint(80, 500))]
        b = list(a)
        for _ in range(max(1, int(len(a) * rng.uniform(0.01, 0.045)))):
            b[rng.randrange(len(b))] = rng.choice(words)
        x, y = (shingle_set(" ".join(t).encode()) for t in (a, b))
        if len(np.intersect1d(x, y)) < 0.8 * len(np.union1d(x, y)):
            continue
        pairs += 1
        alike = (np.frombuffer(sketch(x), np.uint8) == np.frombuffer(sketch(y), np.uint8)).sum() >= equal
        close = (set_fingerprint(x) ^ set_fingerprint(y)).bit_count() <= RADIUS
        found += bool(set(band_keys(x)) & set(band_keys(y))) and close and bool(alike)
    assert found >= 0.99 * pairs
