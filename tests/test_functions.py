from __future__ import annotations

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import ids, scores, text, timebuckets, vectors


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


KEYS = ("eventid=", "status=", "result=", "action=")
MESSAGES = {
    "login from 192.168.7.44 port 2201 took 15 ms": "login from <IP> port <NUM> took <NUM> ms",
    "Status=404 on 12 hosts, eventID=4688, level=3": "Status=404 on <NUM> hosts, eventID=4688, level=<NUM>",
    "disk7 7disk d7d x12 12x x123x": "disk7 7disk d7d x1<NUM> <NUM>2x x1<NUM>3x",
    "at 0xcafebabe not 0xcafe nor 8.8.4.4.8": "at <HEX> not 0xcafe nor <IP>.<NUM>",
    "job 1b4e28ba-2fa1-11d2-883f-b9a761bde3fb ended": "job <UUID> ended",
    "ACTION=7 action = 7 action=7z9 reaction=5": "ACTION=7 action = <NUM> action=7z9 reaction=5",
    "x10.1.2.3y 10.1.2.3": "x1<NUM>.<NUM>.<NUM>.3y <IP>",
    "status=" + "9" * 70 + " result=" + "8" * 200 + "k 77": "status=" + "9" * 70 + " result=" + "8" * 200 + "k <NUM>",
    "": "",
    "\u0663\u0664 seen": "<NUM> seen",
}


def numbers_masked(message: str) -> str:
    """Runs of digits one by one: kept after a key; else a digit that touches a letter stays, and what is left between is masked."""
    out, i = "", 0
    while i < len(message):
        j = i
        while j < len(message) and message[j].isdigit():
            j += 1
        if j == i:
            out, i = out + message[i], i + 1
            continue
        run, letter = message[i:j], lambda c: c == "_" or (c.isascii() and c.isalpha())
        left = 1 if i and letter(message[i - 1]) else 0
        right = len(run) - (1 if j < len(message) and letter(message[j]) else 0)
        out += run if message[:i].lower().endswith(KEYS) or right <= left else run[:left] + "<NUM>" + run[right:]
        i = j
    return out


def test_mask_of_messages(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "m string")
    assert {r.m: r.v for r in df.select("m", text.mask(F.col("m")).alias("v")).collect()} == MESSAGES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "1", "23", "4" * 70, " ", "=", "_", "-", *KEYS]), max_size=14).map("".join), min_size=20, max_size=40))
def test_mask_of_numbers_in_random_text(spark, messages):
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    assert all(r.v == numbers_masked(r.m) for r in df.select("m", text.mask(F.col("m")).alias("v")).collect())


def test_fingerprint_ignores_space_and_case(spark):
    a, b = (one(spark, text.template_fingerprint(F.lit(t))) for t in ("User  <NUM>\tin ", "user <num> in"))
    assert a == b == hashlib.sha256(b"user <num> in").hexdigest()


@pytest.mark.parametrize(("line", "found"), [("2026-01-01T00:00:00Z User x", ("2026-01-01T00:00:00Z", "User x")), ("MALFORMED", (None, "MALFORMED"))])
def test_leading_timestamp(spark, line, found):
    time, rest = text.leading_timestamp(F.lit(line))
    assert (one(spark, time), one(spark, rest)) == found


@pytest.mark.parametrize(("line", "found"), [("<TimeCreated x SystemTime='2020-01-01 10:00:00'/>", "2020-01-01 10:00:00"), ("TIMESTAMP: 2020-01-02", "2020-01-02"), ("UtcTime>2021-05-05 01:02:03<", "2021-05-05 01:02:03"), ("none", None)])
def test_timestamp_of_event(spark, line, found):
    assert one(spark, text.timestamp_of_event(F.lit(line))) == found


def test_timestamp_anywhere(spark):
    assert one(spark, text.timestamp_anywhere(F.lit("at 2020-01-02 03:04:05.678 x"))) == "2020-01-02 03:04:05.678"
    assert one(spark, text.timestamp_anywhere(F.lit("none"))) is None


def test_ids_match_hashes_of_joined_parts(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert one(spark, ids.record_id(F.lit("d"), F.lit("f"), F.lit(3))) == sha("d|f|3")
    assert one(spark, ids.entity_id(F.lit("d"), F.lit("user"), F.lit("é"), F.lit(None))) == sha("d|user|é|")
    assert one(spark, ids.node_id(F.lit("action"), F.lit("x"))) == "action:" + sha("x")[:24]
    assert one(spark, ids.window_id(F.lit("d"), 5, F.lit("2026-01-01 00:05:00").cast("timestamp"))) == "window:" + sha("d|5|2026-01-01T00:05:00+00:00")[:16]


def test_canonical_json_sorts_keys(spark):
    assert one(spark, ids.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'


@pytest.mark.parametrize(("minutes", "start"), [(5, "00:55"), (30, "00:30"), (25, "00:50")])
def test_clock_buckets_restart_each_hour(spark, minutes, start):
    got = one(spark, timebuckets.clock_bucket(F.lit("2026-01-01 00:58:07").cast("timestamp"), minutes))
    assert got.strftime("%H:%M:%S") == f"{start}:00"


def test_epoch_buckets(spark):
    a, b = timebuckets.epoch_buckets(F.lit(3700))
    assert (one(spark, a), one(spark, b)) == (12, 2)


def test_vector_functions(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    null = F.lit(None).cast("array<double>")
    assert one(spark, vectors.cosine(v(1, 0), v(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) == one(spark, vectors.cosine(null, v(1))) == 0.0
    s = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, vectors.jaccard(s("a", "b"), s("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, vectors.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, vectors.sized(v(1, 2, 3), 2)) == [1, 2] and one(spark, vectors.sized(v(1), 3)) == [1, 0, 0]
    assert one(spark, vectors.pair_features(v(1, 2), v(3, 1), v(9), v(8))) == [1, 2, 3, 1, 3, 2, 2, 1, 9, 8]
    assert one(spark, vectors.byte_vector(F.lit("aé"), 5)) == pytest.approx([x / 255 for x in [*"aé".encode(), 0, 0]])


def test_scores(spark):
    assert one(spark, scores.softplus(F.lit(1000.0))) == 1000.0
    assert one(spark, scores.softplus(F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(spark, scores.bce(F.lit(0.0), F.lit(1))) == pytest.approx(math.log(2))
    assert one(spark, scores.focal_bce(F.lit(0.0), F.lit(1))) == pytest.approx(math.log(2) / 4)
    logits = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, scores.slot_nll(logits, F.lit(1))) == pytest.approx(math.log(1 + math.exp(-1)))
    assert one(spark, scores.slot_nll(logits, F.lit(-100))) is None
    assert one(spark, scores.decays(F.lit(-5.0))) == [1, 1, 1]
    assert one(spark, scores.decays(F.lit(3600.0))) == pytest.approx([math.exp(-1), math.exp(-1 / 6), math.exp(-1 / 24)])
