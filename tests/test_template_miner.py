from __future__ import annotations

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.functions.text import mask, squeezed
from logweave.operators import template_miner
from logweave.operators.template_miner import Bucket, mine_stream, mine_templates
from logweave.operators.templates import catalog, masked, merge_similar
from logweave.plans.queries import QUERIES
from logweave.streaming.jobs import run_once


def _brute(messages, threshold=0.4, most=0):
    """(cluster, template, change, size) of each message (bucket, words), comparing with every cluster."""
    state, out = {}, []
    for bucket, words in messages:
        clusters, made = state.setdefault(bucket, ([], [0]))  # [number, words, size, last use]
        hit = next((c for c in sorted(clusters) if sum(a == b for a, b in zip(c[1], words, strict=True)) >= threshold * len(words)), None)
        if hit is None:
            hit = [made[0], list(words), 1, len(out)]
            made[0] += 1
            clusters.append(hit)
            if most and len(clusters) > most:
                clusters.remove(min(clusters, key=lambda c: c[3]))
            change = "created"
        else:
            new = [a if a == b else "<*>" for a, b in zip(hit[1], words, strict=True)]
            change = "none" if new == hit[1] else "changed"
            hit[1], hit[2], hit[3] = new, hit[2] + 1, len(out)
        out.append((hit[0], " ".join(hit[1]), change, hit[2]))
    return out


def _lines(rng, n):
    shapes = [[rng.choice("abcdef") * 3 for _ in range(rng.choice([1, 4, 7]))] for _ in range(12)]
    return [" ".join(w if rng.random() < 0.7 else rng.choice(["xx", "yy", "zz", "7", "host 9"]) for w in rng.choice(shapes)) for _ in range(n)]


def _bucketed(spark, lines):
    """(bucket, words) as the miner has them."""
    masks = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, x string").coalesce(1).orderBy("i").select(squeezed(mask(F.col("x")))).collect()]
    words = [m.split(" ") for m in masks]
    return [(f"{len(w)}|{'<*>' if any(c.isdigit() or c == '<' for c in w[0]) else w[0]}", w) for w in words]


@pytest.mark.parametrize("most", [0, 2])
def test_a_bucket_equals_a_miner_that_compares_with_all(most):
    rng = random.Random(4)
    for threshold in (0.4, 0.7):
        rows = [("b", [rng.choice("ab<c") for _ in range(5)]) for _ in range(400)]
        bucket = Bucket(threshold, most)
        got = []
        for _, words in rows:
            n, change = bucket.add(list(words))
            got.append((n, " ".join(bucket.clusters[n][0]), change, bucket.clusters[n][1]))
        assert got == _brute(rows, threshold, most)
        assert not most or len(bucket.clusters) <= most


@pytest.mark.parametrize("most", [0, 3])
def test_messages_in_order_equal_brute_force(spark, most):
    lines = _lines(random.Random(1), 500) + ["", "  "]
    rows = spark.createDataFrame([(f"{i:04d}", i, x) for i, x in enumerate(lines)] + [("null", 9999, None)], "record_id string, at long, message string").repartition(5)
    found = [(r.cluster, r.template, r.change, r.size) for r in mine_templates(rows, ["at"], max_clusters=most).orderBy("id").collect()]
    assert found == _brute(_bucketed(spark, [*lines, ""]), most=most)


def test_a_stream_goes_on_where_the_last_batch_left(spark, tmp_path):
    lines, path = _lines(random.Random(8), 240), str(tmp_path / "in")
    for k in range(4):  # one file a batch, in order
        spark.createDataFrame([(f"{i:04d}", i, lines[i]) for i in range(60 * k, 60 * k + 60)], "record_id string, at long, message string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("record_id string, at long, message string").option("maxFilesPerTrigger", 1).parquet(path)
    found = run_once(mine_stream(stream, ["at"], max_clusters=3), "mined", str(tmp_path / "checkpoint"))
    assert [(r.cluster, r.template, r.change, r.size) for r in found.orderBy("id").collect()] == _brute(_bucketed(spark, lines), most=3)


def _merged(rows, threshold=0.4):
    """fingerprint -> (cluster, template) of a catalog, comparing with every cluster."""
    clusters, of = {}, {}
    for r in sorted(rows, key=lambda r: (-r.size, r.fingerprint)):
        w = " ".join(r.template.split()).split(" ")
        own = clusters.setdefault((len(w), "<*>" if any(c.isdigit() or c == "<" for c in w[0]) else w[0]), [])
        c = next((c for c in own if sum(a == b for a, b in zip(c[1], w, strict=True)) >= threshold * len(w)), None)
        if c:
            c[1] = [a if a == b else "<*>" for a, b in zip(c[1], w, strict=True)]
        else:
            c = [r.fingerprint, w]
            own.append(c)
        of[r.fingerprint] = c
    return {f: (c[0], " ".join(c[1])) for f, c in of.items()}


def test_merging_a_catalog_equals_brute_force(spark):
    lines = _lines(random.Random(3), 800)
    found = catalog(masked(spark.createDataFrame([(x,) for x in lines], "text string")))
    got = {r.fingerprint: (r.cluster, r.cluster_template) for r in merge_similar(found).collect()}
    assert got == _merged(found.collect()) and len(set(got.values())) < len(got)
    assert merge_similar(found.limit(0)).isEmpty()


def test_the_registered_clusters_equal_brute_force(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(F.explode(F.split("text", "\n")).alias("text"))
    want = _merged(catalog(masked(lines)).collect())
    got = {r.fingerprint: (r.cluster, r.cluster_sha256) for r in QUERIES["template_clusters"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {f: (c, hashlib.sha256(t.encode()).hexdigest()) for f, (c, t) in want.items()}


def test_the_registered_miner_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    lines = [(f"{d.doc_id}|{i}", x) for d in docs if d.text is not None for i, x in enumerate(d.text.split("\n"))]
    rows = _bucketed(spark, [x for _, x in lines])
    want = {n: (hashlib.sha256(f"{b}|{c}|{t}".encode()).hexdigest(), change, size) for (n, _), (b, _), (c, t, change, size) in zip(lines, rows, _brute(rows), strict=True)}
    got = {r.id: (r.template_sha256, r.change, r.size) for r in QUERIES["mined_templates"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_a_long_bucket_of_a_batch_is_held_as_columns(spark, tmp_path):
    """One bucket of more rows than are made objects at once, out of order: as the table's result, and some tens of bytes a row."""
    rows = spark.range(template_miner.TURN + 900).selectExpr("cast(id as string) as record_id", "pmod(id * 7919, 5003) as at", "concat('job ', if(id % 3 = 0, 'starts', 'ends'), ' on node ', char(97 + id % 20), ' ok') as message")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = run_once(mine_stream(stream, ["at"]), "long", str(tmp_path / "checkpoint"))
    want = mine_templates(rows, ["at"], max_clusters=1000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    frames = [pd.DataFrame({"words": ["a b c d"] * 5000, "id": [str(i) for i in range(k, k + 5000)], "place0": pd.Timestamp("2024-01-01"), "place1": range(k, k + 5000)}) for k in (0, 5000)]
    assert template_miner.packed(iter(frames), ["place0", "place1"]).nbytes < 48 * 10_000


@pytest.mark.parametrize("most", [0, 12])
def test_a_bucket_of_few_clusters_keeps_no_places_and_one_of_many_finds_the_same(most, monkeypatch):
    rng = random.Random(6)
    rows = [("b", [rng.choice("abcdefgh<") if rng.random() < 0.6 else rng.choice(["<*>", "x", "y"]) for _ in range(6)]) for _ in range(600)]
    want = _brute(rows, 0.7, most)
    for few in (0, 3, template_miner.FEW, 1000):
        monkeypatch.setattr(template_miner, "FEW", few)
        bucket, got, held = Bucket(0.7, most), [], 0
        for _, words in rows:
            n, change = bucket.add(list(words))
            held = max(held, len(bucket.clusters))
            assert held > few or not bucket.places
            got.append((n, " ".join(bucket.clusters[n][0]), change, bucket.clusters[n][1]))
        assert got == want and (held > few) == bool(bucket.places)
        assert sorted({n for own in bucket.places for s in own.values() for n in s}) == (sorted(bucket.clusters) if bucket.places else [])


def test_words_travel_as_one_string(spark):
    rows = spark.createDataFrame([("1", 1, " a  b\tc 5 "), ("2", 2, ""), ("3", 3, None)], "record_id string, at long, message string")
    found = template_miner._messages(rows, "message", ["at"], "record_id")
    assert dict(found.dtypes)["words"] == "string"
    assert [(r.bucket, r.words) for r in found.orderBy("id").collect()] == [("4|a", "a b c <NUM>"), ("1|", ""), ("1|", "")]


def test_only_messages_without_digit_and_hyphen_skip_the_masks(spark):
    texts = {
        "id aaaaaaaa-BBBB-cccc-dddd-eeeeeeeeeeee ends": "id <UUID> ends", "٣ and ५": "<NUM> and <NUM>", "status=५ n": "status=५ n", "0xABCDEF": "<HEX>", "at ١.2.3.4": "at <IP>",
        "a-b": "a-b", "no number": "no number", "½ ² Ⅷ": "½ ² Ⅷ", "": "",
    }
    found = spark.createDataFrame([(t,) for t in texts], "x string").select("x", mask(F.col("x")).alias("m"))
    assert {r.x: r.m for r in found.collect()} == texts
    assert spark.sql("select cast(null as string) as x").select(mask(F.col("x"))).first()[0] is None
