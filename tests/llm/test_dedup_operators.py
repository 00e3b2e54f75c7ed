"""Near-duplicates, vectors, lines: against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import simhash as sh
from logweave.llm.cap_filters import all_filters, code_parameters, list_decode, vector_groups
from logweave.llm.line_dedup import LineRuns, line_counts, line_dedup

WORDS = [f"w{i}" for i in range(200)]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, link):
    """id -> smallest id reachable, by brute force over all pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and link(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 120))) for _ in range(40)]
    near = []
    for t in base[:25]:
        w = t.split() * 6
        near.append(" ".join(w))
        for _ in range(3):
            x = list(w)
            x[r.randrange(len(x))] = "changed"
            near.append(" ".join(x))
    return [None, "", "\t\n", "One", "ONE", "É é", *base, *near, *base[:10], "word " * 30_000]


def test_simhash_groups_are_those_of_all_pairs(spark, texts):
    got = {r.doc_id: r for r in sh.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp and all(len(r.fingerprint) == 16 for r in got.values())
    want = grouped(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values()) and len(set(want.values())) < len(texts) - 20


@pytest.mark.parametrize("limit", [8, 32])
def test_hot_shards_split_and_lose_nothing(spark, limit):
    """Fingerprints that all agree on most bits: shards split again and again."""
    r = random.Random(limit)
    fps = sorted({0xABCD << 48 | sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)} | {(1 << 64) - 1, (1 << 63) - 1, 0})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = sh.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, limit).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert parent.keys() >= {a, b}
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = grouped(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {x: find(x) for x in signed} == want


def test_bk_tree_follows_the_radius():
    r = random.Random(0)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = sh.BKTree()
    for v in values:
        tree.add(v)
    assert all((tree.values[c] ^ tree.values[p]).bit_count() == d for p, kids in enumerate(tree.children) for d, c in kids.items())
    for q in values[:50] + [r.getrandbits(16) for _ in range(50)]:
        for k in (0, 2, 5):
            assert {tree.values[i] for i in tree.within(q, k)} == {v for v in values if (v ^ q).bit_count() <= k}


def test_near_distinct_keeps_one_of_each_group(spark, texts):
    rows = list(enumerate(texts)) + [(3, "One"), (None, "only here"), (None, "only here"), (None, texts[10])]
    df = spark.createDataFrame([(i, t, "s", "__fp", "x") for i, t in rows], "doc_id long, text string, source string, fp string, component_id string")
    kept = sh.near_distinct(df).collect()
    ids = [r.doc_id for r in kept]
    groups = {r.doc_id for r in sh.simhash_groups(df.where("doc_id is not null")).where("kept").collect()}
    assert sorted(x for x in ids if x is not None) == sorted(groups) and ids.count(None) == 1
    assert kept[0].fp == "__fp" and list(kept[0].asDict()) == df.columns
    assert sh.near_distinct(df.limit(0)).count() == 0


def test_simhash_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [(r.component_id, r.kept) for r in sh.simhash_groups(df).collect()] == [(None, False)] * 2
    assert sh.simhash_groups(df.limit(0)).count() == 0


def vectors_table(seed=1, clusters=12, dim=64):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        base = r.standard_normal(dim)
        for k in range(int(r.integers(1, 14))):
            noise = r.standard_normal(dim) * r.uniform(0, 0.45)
            rows.append(((base + noise) * r.uniform(0.1, 10), c % 3))
    rows += [(r.standard_normal(dim), 1) for _ in range(60)]
    rows += rows[:6]
    out = [(i * 3 % 1000, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    bad = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
    out += [(5000 + i, v, 1) for i, v in enumerate(bad)] + [(6000, out[0][1], None), (6001, out[0][1], None)]
    return out


def brute_vectors(rows, cosine=0.93):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    by = {i: (v, lab) for i, v, lab in ok}
    link = lambda a, b: a in by and b in by and by[a][1] == by[b][1] and len(by[a][0]) == len(by[b][0]) and cos(by[a][0], by[b][0]) >= cosine
    ids = [i for i, _, _ in rows]
    n = {i: sum(link(i, j) for j in ids if j != i) for i in ids}
    return n, grouped(ids, link)


@pytest.mark.parametrize(("seed", "dim"), [(1, 64), (2, 64), (3, 5), (4, 8), (5, 3), (6, 2)])
def test_vector_groups_are_those_of_all_pairs(spark, seed, dim):
    rows = vectors_table(seed, dim=dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = {r.vec_id: r for r in vector_groups(df).collect()}
    n, root = brute_vectors(rows)
    assert len(got) == len(rows)
    missed = sum(got[i].n_links != n[i] for i in n)
    assert sum(got[i].n_links for i in n) <= sum(n.values()) and missed <= 0.02 * len(rows)
    if not missed:
        assert {i: r.component_id for i, r in got.items()} == root and all(r.kept == (r.component_id == i) for i, r in got.items())


def test_vectors_of_one_dimension_link_by_sign(spark):
    rows = [(i, [float((i + 1) * (-1) ** i)], 1) for i in range(9)]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {g.vec_id: (g.n_links, g.component_id) for g in got} == {i: (4 - i % 2, i % 2) for i in range(9)}


def test_a_heavy_label_among_small_ones_has_its_own_bar(spark):
    """One label of 3000 and 300 of one to four: pairs at cosines around the bound, recall over all."""
    r = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        a, b = r.standard_normal(64), r.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.925 + 0.02 * r.random()
        rows += [(a, 0), (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b), 0)]
    for k in range(300):
        base = r.standard_normal(64)
        rows += [(base + 0.05 * r.standard_normal(64), 1 + k) for _ in range(1 + k % 4)]
    rows = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    got = {g.vec_id: g.n_links for g in vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {}
    for lab in range(301):
        ids = [i for i, _, x in rows if x == lab]
        v = np.array([rows[i][1] for i in ids])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        want |= dict(zip(ids, ((v @ v.T >= 0.93).sum(1) - 1).tolist(), strict=True))
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values()) and {i: got[i] for i, _, x in rows if x} == {i: want[i] for i, _, x in rows if x}
    assert code_parameters(4096, 64, 0.93)[0] > code_parameters(4, 64, 0.93)[0]


def test_vectors_with_repeated_and_null_ids_and_rows(spark):
    v, w = [1.0] * 16, [-1.0] * 15 + [3.0]
    rows = [(5, v, 1), (5, v, 1), (3, v, 1), (None, v, 1), (5, w, 1), (None, w, 2), (8, None, 1), (8, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"kept": F.lit("own"), "filter": F.lit(1)})
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vector_groups(df).collect())
    assert got == sorted([(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (-1, 3, 3, False), (5, 0, 5, True), (-1, 0, -1, False), (8, 0, 8, True), (8, 0, 8, True)])


def test_large_groups_are_tiled(spark, monkeypatch):
    from logweave.llm import cap_filters

    monkeypatch.setattr(cap_filters, "TILE", 16)
    r = np.random.default_rng(3)
    base = r.standard_normal(64)
    rows = [(i, [float(x) for x in base + r.standard_normal(64) * 0.1], 1) for i in range(150)]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    n, root = brute_vectors(rows)
    assert {g.vec_id: g.n_links for g in got} == n and {g.vec_id: g.component_id for g in got} == root


def test_list_decoding_finds_all_directions():
    from logweave.llm.cap_filters import _code

    r = np.random.default_rng(1)
    x = r.standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, parts = _code(24, 3, 9, 5)
    t = x @ turn
    a, b, c = (t[:, s : s + 8] @ p.T for s, p in zip((0, 8, 16), parts, strict=True))
    total = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(20, -1)
    for got, s in zip(list_decode(x, 0.3, 3, 9, 5), total, strict=True):
        assert got.tolist() == np.flatnonzero(s >= 0.3 * 3**0.5).tolist()


@pytest.mark.parametrize("n", [1000, 100_000])
def test_filters_recall_pairs_at_the_bound(n):
    r = np.random.default_rng(0)
    a = r.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((300, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = code_parameters(n, 64, 0.93)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(all_filters(a, *code, 7), all_filters(b, *code, 7), strict=True)]
    assert np.mean(met) >= 0.97


def test_vectors_without_rows(spark):
    assert vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_lines(texts, min_docs):
    strip = " \t\n\x0b\f\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    lines = [(t or "").split("\n") for t in texts]
    seen = {}
    for doc in lines:
        for k in {key(x) for x in doc}:
            seen[k] = seen.get(k, 0) + 1
    bad = {k for k, n in seen.items() if n >= min_docs and k}
    return [(len(doc), sum(key(x) in bad for x in doc), "\n".join(x for x in doc if key(x) not in bad)) for doc in lines]


@pytest.fixture(scope="module")
def line_texts():
    r = random.Random(8)
    pool = ["Shared Line", "  shared line\t", "É", "é", " x", "", "  ", "once"] + [f"l{i}" for i in range(30)]
    out = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)]
    return [None, "", "\n", "x", *out, out[0], out[0], "\n".join(f"n{i}" for i in range(20_000)), "shared line\n" * 500]


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_lines_are_dropped_as_by_definition(spark, line_texts, batches):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(line_texts)], "doc_id long, text string, n_lines string")
    got = line_dedup(df, 10, batches=batches).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == brute_lines(line_texts, 10)
    assert sum(r.n_dropped for r in got) > 500


def test_lines_with_null_and_repeated_ids(spark, line_texts):
    df = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(line_texts)], "doc_id long, text string")
    got = sorted((r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(df, 10).collect())
    assert got == sorted(brute_lines(line_texts, 10))
    assert line_dedup(df.limit(0), 10).count() == 0


def test_a_list_and_a_shuffle_drop_the_same_lines(spark, line_texts):
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(line_texts)], "doc_id long, text string")
    ways = [sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(df, 10, max_listed=n).collect()) for n in (0, 1000)]
    assert ways[0] == ways[1]


def test_runs_leave_no_tables_or_files(spark, tmp_path, line_texts):
    from pathlib import Path

    from logweave.operators.pinning import shared_folder

    left = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("line_run_*")} | {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}
    before = left()
    line_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(line_texts)], "doc_id long, text string"), 10).count()
    runs = LineRuns(spark, 2)
    runs.add(line_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string")).drop("batch"))
    assert left() > before
    runs.close()
    assert left() == before


def test_runs_compact_and_count_over_batches(spark):
    runs = LineRuns(spark, 3, fanout=2)
    for b in range(5):
        df = spark.createDataFrame([(b * 2, "always\nnever %d" % b), (b * 2 + 1, f"pair {b // 2}")], "doc_id long, text string")
        runs.add(line_counts(df).drop("batch"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five runs: four merged twice, one left
    assert runs.frequent().count() == 1  # "always"; it is no longer counted once it is known
    counts = [r.n_docs for run in runs.runs() for r in run.collect()]
    assert max(counts) < 5 and all(t.schema.names == ["h1", "h2", "n_docs"] for t in runs.runs())
    runs.close()


def test_kept_text_hash_is_of_utf8(spark):
    df = spark.createDataFrame([(1, "é\nb")], "doc_id long, text string")
    assert line_dedup(df).select(F.sha2("kept_text", 256)).first()[0] == hashlib.sha256("é\nb".encode()).hexdigest()
