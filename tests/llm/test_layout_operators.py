"""Mixing, packing, sharding and the pipeline: against brute force, round trips and their own limits."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.llm import packing as pk
from logweave.llm.mixing import mix_sources, mixed_documents
from logweave.llm.sharding import shard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix_table(seed=3, n=400):
    r = random.Random(seed)
    sources = ["b", "a", "ä", "Z", None, "empty"]
    rows = [(i, "" if s == "empty" else " ".join(["w"] * r.choice([1, 3, 10, 40, 200])), s) for i in range(n) for s in [r.choices(sources, [12, 3, 2, 2, 1, 0.3])[0]]]
    return [*rows, (9001, None, "a"), (9002, "x\ty z\n", "a")]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, capped and dealt again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_mix_meets_its_targets(spark, seed):
    rows = mix_table(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own")).withColumn("p", F.lit(1))
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    want = targets(dict(by))
    taken = defaultdict(int)
    for i, _, s in rows:
        g = got[i]
        assert (g.size, g.source_size) == (size[i], by[s]) and g.target == pytest.approx(want[s]) and g.taken == g.copies * g.size <= 2 * g.size
        taken[s] += g.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in want)
    assert got[1].p == 1
    again = {r.doc_id: r.taken for r in mix_sources(df.repartition(7)).collect()}
    assert again == {i: g.taken for i, g in got.items()}


def test_mix_samples_differ_with_the_seed_and_are_fair(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    runs = [{r.doc_id for r in mix_sources(df, share=0.5, seed=s).where("copies > 0").collect()} for s in range(4)]
    assert runs[0] != runs[1]
    c = [i for i in range(600) if i % 3 == 2]  # the lightest source: about a fifth of it is taken
    share = np.mean([sum(i in run for i in c) / len(c) for run in runs])
    assert 0.1 < share < 0.3 and 0.05 < np.mean([len({i for i in run if i % 3 == 2 and i % 7 == 6}) for run in runs]) / len([i for i in c if i % 7 == 6]) < 0.4


def test_mix_edges(spark):
    kind = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], kind)).count() == 0
    same = spark.createDataFrame([(None, "a b", "s")] * 3 + [(1, "", "t")], kind)
    got = mix_sources(same).collect()
    assert len(got) == 4 and len({r.taken for r in got if r.source == "s"}) == 1
    out = mixed_documents(spark.createDataFrame([(i, "w " * 5, "s") for i in range(40)], kind))
    assert out.columns == ["doc_id", "text", "source"] and out.count() == 60
    assert max(Counter(r.doc_id for r in out.collect()).values()) == 2


def check_patterns(histogram, capacity):
    patterns = pk.plan_patterns(histogram, capacity)
    got = Counter()
    for n, content in patterns:
        assert n > 0 and sum(x * k for x, k in content) <= capacity
        for x, k in content:
            got[x] += n * k
    assert got == Counter({k: v for k, v in histogram.items() if v})
    return sum(n for n, _ in patterns)


def fewest(items, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(items)]

    def go(rest, room):
        if len(room) >= best[0]:
            return
        if not rest:
            best[0] = len(room)
            return
        for i in range(len(room)):
            if room[i] >= rest[0] and room[i] not in room[:i]:
                go(rest[1:], [*room[:i], room[i] - rest[0], *room[i + 1 :]])
        go(rest[1:], [*room, capacity - rest[0]])

    go(sorted(items, reverse=True), [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_packing_is_near_the_fewest(items):
    n = check_patterns(Counter(items), 20)
    assert n <= fewest(items, 20) + (len(items) > 6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_dominance_costs_nothing(items):
    """What the reduction fixes leaves an instance that needs exactly that many fewer."""
    counts = [0] * 21
    for x in items:
        counts[x] += 1
    fixed = sum(n for n, _ in pk.reduce_by_dominance(counts, 20))
    rest = [x for x in range(21) for _ in range(counts[x])]
    assert fixed + fewest(rest, 20) == fewest(items, 20)


def test_large_histograms_pack_in_bulk():
    r = random.Random(2)
    h = Counter(min(2048, max(1, int(r.lognormvariate(6, 0.8)))) for _ in range(100_000))
    assert check_patterns(h, 2048) <= 1.002 * sum(k * v for k, v in h.items()) / 2048 + 1


def pieces_by_hand(text):
    from tokenizers import Tokenizer

    from logweave.llm.token_counts import vocabulary_path

    ids = [*Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids), 2048), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_documents_pack_without_loss_or_gaps(spark):
    r = random.Random(6)
    texts = [None, "", "a <|endoftext|> b", "word " * 5000, "x" * 9000, "word " * 2047, "word " * 2048, *[" ".join(r.choices("alpha beta gamma é 12".split(), k=r.randint(1, 900))) for _ in range(60)]]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id"), *[(100 + i, "same text") for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("own"))
    got = pk.pack_documents(df).collect()
    want = Counter((i, *p) for i, t in rows for p in pieces_by_hand(t))
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(g.length for g in got) / 2048 * 1.05 + 2
    assert pk.pack_documents(df.limit(0)).count() == 0
    ids = pk.token_pieces(df.where("doc_id = 2"), with_ids=True).first()
    assert zlib.crc32(np.array(ids.ids, "<u4").tobytes()) == ids.ids_crc32 and ids.ids[-1] == 0


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError, match="lengths"):
        pk.pack(spark.createDataFrame([(9,)], "length long"), "length", 8)


def test_shards_fit_and_split_only_where_needed(spark):
    r = random.Random(1)
    rows = [(i, "é" * r.randint(0, 60)) for i in range(300)] + [(1000, "x" * 900), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("depth", F.lit("own"))
    got = shard_documents(df, 500).collect()
    assert Counter(g.doc_id for g in got) == Counter(i for i, _ in rows)
    shards = defaultdict(list)
    for g in got:
        shards[g.shard, g.page].append(g.n_bytes)
        assert g.shard == "root" and g.depth == 0 or len(g.shard) == g.depth
    for g in got:
        assert g.shard_bytes == sum(shards[g.shard, g.page])
    assert all(sum(v) <= 500 or len([x for x in v if x]) == 1 for v in shards.values())
    names = {s for s, _ in shards}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # prefix-free
    for s in names - {"root"}:  # its parent was too large
        assert sum(g.n_bytes for g in got if g.shard.startswith(s[:-1])) > 500
    assert {g.shard for g in shard_documents(df, 10**6).collect()} == {"root"}
    assert shard_documents(df.limit(0)).count() == 0


def test_repeated_rows_go_to_pages(spark):
    df = spark.createDataFrame([(7, "x" * 10)] * 95 + [(8, "y")], "doc_id long, text string")
    got = shard_documents(df, 100).collect()
    pages = Counter((g.shard, g.page) for g in got if g.doc_id == 7)
    assert len(got) == 96 and max(pages.values()) == 10 and len(pages) == 10 and all(g.shard_bytes <= 100 for g in got)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version of itself, on what the one before kept."""
    import corpus_pipeline as cp
    from test_dedup_operators import brute_fingerprint, brute_lines, grouped

    from logweave.llm.quality_rules import judge

    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(12, 80))) + "." for _ in range(60)]
    texts = [t + ("\nThis line is in many of them." if i % 3 == 0 else "") for i, t in enumerate(texts)]
    texts += texts[:8] + ["Home | About | News | Shop\n" * 9, "too short", None, ""]
    rows = [(i, t, "en", f"src{i % 4}", len(t or ""), "mine", "mine", "mine") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((x.doc_id, x.text) for x in docs.collect())
        assert all(x.n_chars == len(x.text) and (x.kept, x.n_lines, x.size) == ("mine", "mine", "mine") for x in docs.collect())
    judged = [(i, judge(t)) for i, t, *_ in rows]
    clean = [(i, j[10]) for i, j in judged if j[6]]
    assert kept["quality_rules"] == clean and len(clean) == 68
    lines = brute_lines([t for _, t in clean], 10)
    assert kept["line_dedup"] == [(i, t) for (i, _), (_, _, t) in zip(clean, lines, strict=True)]
    fp = {i: brute_fingerprint(t) for i, t in kept["line_dedup"]}
    reps = set(grouped(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2).values())
    assert [i for i, _ in kept["near_dedup"]] == sorted(reps) and len(reps) <= 60
    before, after = dict(kept["near_dedup"]), Counter(kept["mixing"])
    total = sum(len(t.split()) for t in before.values())
    assert set(after) <= set(before.items()) and max(after.values()) <= 2
    assert abs(sum(len(t.split()) * n for (_, t), n in after.items()) - 1.5 * total) < 0.02 * total
    packed = cp.run(spark, str(tmp_path)).collect()
    assert Counter((g.doc_id, *p) for g in packed for p in [(g.piece, g.start, g.length, g.ids_crc32)]) == Counter((i, *p) for (i, t), n in after.items() for _ in range(n) for p in pieces_by_hand(t))


def test_entry_registers_each_operator_once():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
