from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from logweave.llm.phrases import Summary, collocations, frequent_phrases, language
from logweave.llm.queries import op12_phrase_collocations


def _expected(rows, least, top=2000, most=4):
    counts, totals = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang if lang is not None else "und"] += len(w)
            for n in range(1, most + 1):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        found = {g: f for g, f in own.items() if f >= least}
        longest = Counter()
        for g, f in found.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    longest[g[i : i + n]] = max(longest[g[i : i + n]], f)
        kept = []
        for g, a in found.items():
            if len(g) > 1 and 100 * longest[g] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out, key=str)


def _texts(rng, n):
    words = ["the", "of", "New", "YORK", "city", "é", "x\u00a0y", "a", "b"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ", "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("least", [5, 30])
def test_collocations_equal_brute_force(spark, rows, least):
    data = [*_texts(random.Random(least), 300), (None, "en"), ("", None), ("new york city " * 40, "en")]
    docs = spark.createDataFrame(data, "text string, lang string").selectExpr("*", "1 as phrase", "2 as n").repartition(5)
    assert rows(collocations(docs, min_count=least)) == _expected(data, least)
    assert rows(collocations(docs, min_count=least, top=3)) == _expected(data, least, top=3)
    assert collocations(docs.limit(0)).count() == 0


def test_frequent_phrases_survive_small_summaries(spark, rows):
    """Summaries far smaller than what is counted: nothing frequent is lost, and what is counted is exact."""
    rng = random.Random(9)
    data = [(" ".join(str(min(int(rng.paretovariate(0.7)), 5000)) for _ in range(200)), "en") for _ in range(300)]
    docs = spark.createDataFrame(data, "text string, lang string").select("text", language("lang").alias("lang"))
    found = {(r.phrase, r.f) for r in frequent_phrases(docs, 60_000, 20, 3, summary=512).collect()}
    want = Counter()
    for text, _ in data:
        w = text.split()
        for n in (1, 2, 3):
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    assert found == {(p, f) for p, f in want.items() if f >= 20}


def test_a_summary_keeps_its_bound_and_its_guarantee():
    rng = np.random.default_rng(5)
    keys = rng.zipf(1.2, 200_000).astype(np.uint64) % np.uint64(1 << 40)
    threshold = 50
    summary = Summary(len(keys) // threshold + 1, threshold)
    for part in np.array_split(keys, 40):
        own, counts = np.unique(part, return_counts=True)
        summary.add(own, counts)
    survivors = set(summary.survivors().tolist())
    own, counts = np.unique(keys, return_counts=True)
    assert set(own[counts >= threshold].tolist()) <= survivors
    assert 0 < summary.taken < threshold and len(summary.keys) <= summary.capacity < len(own)


def test_query_equals_brute_force(spark, rows):
    folder = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    assert rows(op12_phrase_collocations(spark, folder)) == _expected(data, 30)
