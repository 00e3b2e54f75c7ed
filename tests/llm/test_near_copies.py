"""Near copies at a similarity of 0.8 or more, against exact similarities of all pairs."""

from __future__ import annotations

import random

import pytest

from logweave.llm.near_copies import similar_distinct

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(r, text, low, high):
    """`text` with scattered words replaced, at a similarity from `low` to `high`."""
    w = text.split()
    while True:
        x = list(w)
        for i in r.sample(range(len(w)), r.randint(1, max(1, len(w) // 20))):
            x[i] = f"new{r.randrange(10**9)}"
        if low <= similarity(shingles(text), shingles(" ".join(x))) <= high:
            return " ".join(x)


def test_stage_finds_copies_from_080_to_095_and_only_those(spark):
    import corpus_pipeline as cp

    r = random.Random(8)
    base = [" ".join(r.choices(WORDS, k=r.randint(120, 600))) for _ in range(60)]
    near = [edited(r, t, 0.8, 0.95) for t in base]
    other = [" ".join(r.choices(WORDS, k=100)) for _ in range(20)]
    apart = [*other, *[edited(r, t, 0.6, 0.79) for t in other]]
    away = [" ".join(t.split()[::-1]) for t in base[:10]]
    rows = list(enumerate([*base, *near, *apart, *away]))
    kept = {x.doc_id for x in cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == set(range(60)) | set(range(120, len(rows)))


@pytest.mark.parametrize("limit", [8, 256])
def test_no_pair_stays_and_all_that_goes_is_linked(spark, limit):
    """Groups of very different sizes, also beyond a shard's limit, and pairs on both sides of 0.8."""
    r = random.Random(limit)
    texts = [None, "", " \t", "one", "ONE", "a b c"]
    for n in [60, 20, *[3] * 10]:
        t = " ".join(r.choices(WORDS, k=200))
        texts += [t, *[edited(r, t, 0.7, 1) for _ in range(n)]]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in similar_distinct(df, shard_limit=limit).collect()}
    sets = [shingles(t) for t in texts]
    links = {i: [j for j in range(len(sets)) if j != i and similarity(sets[i], sets[j]) >= 0.8] for i in range(len(sets))}
    assert not any(j in kept for i in kept for j in links[i])
    reached, todo = set(kept), list(kept)
    while todo:
        fresh = [j for j in links[todo.pop()] if j not in reached]
        reached.update(fresh)
        todo += fresh
    assert reached == set(range(len(texts))) and len(kept) < len(texts) - 40


def test_ids_ties_and_empty_tables(spark):
    text = " ".join(WORDS[:50])
    df = spark.createDataFrame([(4, text, "x"), (2, text.upper(), "y"), (2, text, "z"), (None, text, "n"), (None, "other", "n"), (None, "other", "n"), (7, None, "e"), (8, "", "e")], "doc_id long, text string, key string")
    assert sorted(((r.doc_id, r.key in "yz") for r in similar_distinct(df).collect()), key=str) == [(2, True), (7, False), (None, False)]
    assert similar_distinct(df.limit(0)).count() == 0 and similar_distinct(df).columns == df.columns


def test_what_stays_hangs_on_no_size(spark):
    """The same rows stay whatever the shard limit, and whatever else there is that shares no words with them."""
    r = random.Random(3)
    texts = []
    for n in [40, 24, 18, 12, 9, 9, 6, 6]:
        t = " ".join(r.choices(WORDS, k=120))
        texts += [t, *[edited(r, t, 0.7, 0.95) for _ in range(n)]]
    more = [" ".join(f"z{w}" for w in r.choices(WORDS, k=120)) for _ in range(3)]
    more = [x for t in more for x in [t, *[" ".join([*t.split()[:-1], f"y{k}"]) for k in range(30)]]]
    stay = lambda rows, limit: {x.doc_id for x in similar_distinct(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shard_limit=limit).collect() if x.doc_id < len(texts)}
    one = stay(texts, 1024)
    assert stay(texts, 4) == one and stay([*texts, *more], 24) == one and len(one) > 8
