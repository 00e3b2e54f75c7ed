from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from logweave.llm.queries import op11_periodic_runs
from logweave.llm.word_runs import SuffixPaths, collapsed, periodic_runs, text_runs


def _runs(w, least=24, periods=3):
    """All runs by trying every period."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            seg = w[s : i + q]
            if len(seg) >= max(least, periods * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((s, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _text(rng):
    words, kinds = [], rng.choice([1, 2, 3, 40])
    while len(words) < rng.randint(0, 160):
        block = [str(rng.randrange(kinds)) for _ in range(rng.randint(1, 20))]
        words += (block * rng.randint(1, 8))[: rng.randint(1, 80)]
    return [w.encode() for w in words]


@pytest.mark.parametrize(("least", "periods"), [(24, 3), (6, 3), (10, 3), (3, 3), (12, 4)])
def test_runs_equal_brute_force(least, periods):
    rng = random.Random(least)
    texts = [_text(rng) for _ in range(300)]
    want = [_runs(t, least, periods) for t in texts]
    assert text_runs(texts, least, periods) == want and sum(map(len, want)) > 20


def test_automaton_gives_last_places_of_suffixes():
    rng, words = random.Random(1), []
    paths = SuffixPaths(120)
    for i in range(120):
        words.append(rng.randrange(2))
        for end, length in paths.append(words[-1]):
            if length:
                suffix = words[i + 1 - length :]
                assert end == max(j for j in range(length - 1, i) if words[j + 1 - length : j + 1] == suffix)


def test_collapsing_keeps_a_first_period():
    words = [b"x", *[b"a", b"b", b"c"] * 9, b"y"]
    assert collapsed(words, _runs(words)) == [b"x", b"a", b"b", b"c", b"y"]


def _expected(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force_on_whole_texts(spark, rows):
    folder = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 1500]
    ids = {r.doc_id for r in docs}
    got = [r for r in rows(op11_periodic_runs(spark, folder), *COLUMNS) if r[0] in ids]
    assert got == sorted((_expected(*r) for r in docs), key=str) and sum(r[1] for r in got) > 5


def test_edges(spark, rows):
    long = "w " * 60_000
    data = [(None, "a " * 40), (1, None), (2, ""), (2, ""), (3, long), (4, "\t\n"), (5, "é\u00a0x " * 30)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as n_runs", "2 as __text")
    got = {(r.doc_id, r.n_words): r for r in periodic_runs(docs, whole=True).collect()}
    assert [tuple(x) for x in got[(None, 40)].runs] == [(0, 40, 1)] and got[(None, 40)].collapsed == "a"
    assert got[(1, 0)].n_runs == 0 and got[(1, 0)].start is None and got[(1, 0)].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[(3, 60_000)].start, got[(3, 60_000)].length, got[(3, 60_000)].exponent_milli) == (0, 60_000, 60_000_000)
    assert got[(5, 30)].collapsed == "é\u00a0x" and len(got) == 6 and periodic_runs(docs).count() == 7
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="three"):
        periodic_runs(docs, min_periods=2)
