"""Quality rules, token counts, licences, site quality: against plain definitions and planted cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.llm import quality_rules as qr
from logweave.llm import token_counts as tc
from logweave.llm.license_scan import fit_license_model, license_paragraphs, license_scan, words_of
from logweave.llm.license_templates import TEMPLATES
from logweave.llm.quality_rules import Rules, judge, line_fault, quality_rules, repeated_words
from logweave.llm.site_quality import site_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog, and then it rests near an old stone bridge."
EDGE = [None, "", " \n\t", "a", "  x", "é" * 50, "x\n" * 30, PROSE, PROSE, "word " * 5000, "a" * 200_000]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def test_quality_counts_are_those_of_the_definition(spark):
    r = random.Random(1)
    texts = EDGE + ["".join(r.choice("ab c\n#|\t\x0b é") for _ in range(300)) for _ in range(40)]
    got = quality_rules(docs(spark, texts), carry=["doc_id"]).collect()
    for g in got:
        want = brute_counts(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == want
        assert not (g.base_failed and g.kept)


@pytest.mark.parametrize(("line", "fault"), [
    (PROSE, None), ("", None), ("Home | About | News | Contact us", "navigation"), ("Wow!! Buy!! Now!! Cheap!!", "shouting"), ("THIS IS ALL IN CAPITALS AND LONG", "shouting"), ("Of%%% the*** and&&& it###", "symbols"),
    ("Click here to read on", "boilerplate"), ("word " * 201, "punctuation"), ("Released under the MIT License.", None), ("What a day! It was fine, we said, and then we all went home.", None), ("+1 (555) 010-2030 a.b@c.example", None),
])
def test_line_rules(line, fault):
    assert line_fault(line) == fault


def test_documents_lose_failing_lines_or_go(spark):
    junk = "\n".join(["Home | About | News | Contact"] * 30)
    mild = PROSE + "\nHome | News\n| a | b |\nSome other sentence with quite different words follows here."
    got = {r.doc_id: r for r in quality_rules(docs(spark, [PROSE, junk, mild]), cleaned=True).collect()}
    assert got[0].kept and got[0].cleaned == PROSE and not got[1].kept
    assert got[2].kept and "Home" not in got[2].cleaned and "| a | b |" not in got[2].cleaned and got[2].n_bad_lines == 2


def test_quality_with_clashing_columns_and_no_rows(spark):
    df = docs(spark, [PROSE]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(7))
    out = quality_rules(df)
    assert out.columns.count("n_words") == 1 and out.first().n_words == 18 and "text" in out.columns
    assert quality_rules(df.limit(0)).count() == 0


def test_repeated_words_counts_windows_once():
    assert repeated_words(list("abcdeabcde"), 5) == 10 and repeated_words(list("aaaaaa"), 5) == 6 and repeated_words(list("abcd"), 5) == 0
    assert judge("a b c d e f g h i j")[5] is False and judge("a b c d e f g h i")[5] is True


TOKEN_TEXTS = [*EDGE, "a <|endoftext|> b", "<|endoftext|>" * 3, "it's 123abc  \n\n x", "日本語のテキスト。" * 50, "\x00\x1c\x85  ", ("lorem ipsum " * 20_000) + "é", "  " * 70_000 + "x", "<|endoftext|> " * 9000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library_s(spark, name):
    texts = TOKEN_TEXTS if name == "byte_bpe_50k.json" else TOKEN_TEXTS[:9] + ["日本語 text"]
    path = tc.vocabulary_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x or "")) for x in texts]
    got = tc.token_counts(docs(spark, texts), name).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((x or "").encode()) for x in texts]
    assert [r.over_limit for r in got] == [n > 512 for n in want]


def test_both_libraries_agree_on_every_code_point():
    from tokenizers import Tokenizer

    path = tc.vocabulary_path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), tc.encoder(path, tc.ranks_of(path))
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for s in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in points[s : s + 50_000]]
        assert all(e.ids == ids.tolist() for e, ids in zip(slow.encode_batch_fast(texts, add_special_tokens=False), fast(texts), strict=True))


def test_safe_chunks_join_and_cut_before_space():
    text = "".join(random.Random(2).choices("ab \n\t,1", k=5000))
    parts = tc.safe_chunks(text, 100)
    assert "".join(parts) == text and len(parts) > 20 and all(p[0].isspace() and not q[-1].isspace() for q, p in zip(parts, parts[1:], strict=False))
    assert tc.safe_chunks("x" * 500, 100) == ["x" * 500]


def test_licences_are_found_and_confirmed(spark):
    held = {"MIT": "Distributed under the MIT license, see the LICENSE file.", "Apache-2.0": "This file is licensed under the Apache License, Version 2.0 by its authors.", "GPL-3.0": "The text is licensed under the GNU General Public License, version 3, by us.", "CC-BY-NC": "Photos: licensed under CC BY-NC 4.0."}
    texts = [f"{PROSE}\n{t}\n{PROSE}" for t in held.values()] + [PROSE, None, "", "A license to drive a car is hereby required. The public library is free software for the mind.", "x " * 30_000, PROSE]
    got = license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in got[:4]] == list(held) and all(r.probability > 0.6 and r.n_confirmed == 1 for r in got[:4])
    assert all(r.licenses == "" for r in got[4:]) and got[5].n_lines == 1
    assert license_scan(docs(spark, []).limit(0)).count() == 0


def test_licence_model_on_held_out_variants(spark):
    model = fit_license_model([PROSE] * 5)
    r = random.Random(9)
    right = total = 0
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = words_of(t.encode())
            if len(w) < 8:
                continue
            for _ in range(5):
                total += 1
                kept = [x for x in w if r.random() > 0.1]
                right += model.classify(kept)[0] == family
    assert right / total > 0.9
    assert model.classify([])[0] == "unknown" and model.classify(words_of(PROSE.encode()))[0] == "unknown"
    again = fit_license_model([PROSE] * 5)
    assert (again.weights == model.weights).all()
    df = license_paragraphs(docs(spark, ["a\nReleased under the MIT License.\nb"]), model).first()
    assert [(x.line, x.family, x.confirmed) for x in df.found] == [(1, "MIT", True)]


def quality_table(spark, n=400):
    r = random.Random(4)
    rows = []
    for i in range(n):
        bad = r.random() < 0.3
        text = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + ("%%%" if bad else "") for _ in range(40)) + "."
        rows.append((i, text, None if i % 50 == 0 else f"h{i % 7}", f"p{i % 3}", 0 if bad else 1))
    return rows


def test_site_quality_on_held_out_labels(spark):
    rows = quality_table(spark)
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality(df, labels).collect()}
    assert len(got) == len(rows) and sum(got[r[0]].kept == bool(r[4]) for r in rows if r[0] % 2 == 0) >= 0.97 * len(rows) / 2
    assert all(0 < r.path_rate < 1 and 0 < r.host_rate < 1 for r in got.values())


def test_sites_pull_documents_without_evidence(spark):
    """Texts that say nothing: a good host's documents end above a bad host's, and a sparse host near all."""
    rows = [(i, "same words here", "good" if i < 100 else "bad" if i < 200 else "rare", "p", 1 if i < 100 or i % 10 == 0 else 0) for i in range(202)]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:200]], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality(df, labels).collect()}
    assert got[5].host_rate > 0.9 > got[201].host_rate > 0.3 > got[105].host_rate and got[5].quality > got[201].quality > got[105].quality


def test_site_quality_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "a", None), (1, "", "a", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert site_quality(df, labels).count() == 3
    assert site_quality(df.limit(0), labels).count() == 0


def test_rules_are_parameters():
    assert judge("a b", Rules(min_words=1))[5] is False


def test_wrapped_notices_are_one_paragraph():
    import textwrap

    model = fit_license_model([PROSE] * 5)
    for family, notices in TEMPLATES.items():
        for notice in notices:
            lines = [PROSE.encode(), *textwrap.fill(notice, 72).encode().split(b"\n"), PROSE.encode()]
            found = [(k, *model.classify(words)) for k, words in model.paragraphs(lines)]
            assert {(k, f) for k, f, _, _, sure in found if sure} >= {(1, family)} and {f for _, f, _, _, sure in found if sure} == {family}, notice
    two = model.paragraphs([b"Released under the MIT License.", b"Licensed under the ISC License.", b""])
    assert [(k, model.classify(w)[0]) for k, w in two] == [(0, "MIT"), (1, "ISC")]


def brute_license(text, model):
    """Every n-gram of every paragraph looked up, probabilities and shares of pairs written out."""
    out, found = [], []
    for k, line in enumerate((text or "").encode().split(b"\n")):
        w = re.findall(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*", line.lower())
        pairs = set(zip(w, w[1:], strict=False))
        known = sum(a + b" " + b in model.known for a, b in pairs)
        whole = any(len(pairs & set(t)) >= 0.9 * len(t) for ts in model.templates for t in ts if t)
        part = bool(pairs) and known >= 0.5 * len(pairs) and sum(x in model.known for x in w) >= 0.5 * len(w) and not whole
        if part and out and out[-1][2] and out[-1][3] == k - 1:
            out[-1] = (out[-1][0], out[-1][1] + w, True, k)
        else:
            out.append((k, w, part, k))
    for k, w, _, _ in out:
        grams = {model.known[b" ".join(w[i : i + n])] for n in (1, 2, 3) for i in range(len(w) - n + 1) if b" ".join(w[i : i + n]) in model.known}
        z = [(model.bias[c] + (sum(model.weights[g][c] for g in grams) / len(grams) ** 0.5 if grams else 0)) / model.temperature for c in range(len(model.families))]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(z) - 1), key=lambda c: p[c])
        if p[best] / sum(p) >= 0.6:
            pairs = set(zip(w, w[1:], strict=False))
            share = max((len(pairs & t) / min(len(pairs), len(t)) if pairs & t and len(pairs & t) >= min(2, len(t)) else 0) for t in model.templates[best])
            found.append((k, model.families[best], round(p[best] / sum(p), 9), share >= 0.5))
    return found


def test_license_scan_by_brute_force(spark):
    r = random.Random(4)
    pool = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    notices = [t for ts in TEMPLATES.values() for t in ts]
    line = lambda: r.choice([PROSE, r.choice(notices), " ".join(r.choice(pool) for _ in range(r.randint(1, 12))), r.choice(notices)[: r.randint(10, 200)], ""])
    texts = ["\n".join(line() for _ in range(r.randint(1, 9))) for _ in range(120)]
    model = fit_license_model([PROSE] * 5)
    got = license_paragraphs(docs(spark, texts), model).collect()
    for g in got:
        assert [(x.line, x.family, round(x.probability, 9), x.confirmed) for x in g.found] == brute_license(texts[g.doc_id], model)
    assert sum(len(g.found) for g in got) > 100


def test_license_scan_with_clashing_names_null_ids_and_repeated_rows(spark):
    rows = [(None, "Released under the MIT License."), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, "word " * 200_000 + "\nLicensed under the ISC License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "n_lines": F.lit("own"), "licenses": F.lit("none")})
    got = sorted((r.doc_id or 0, r.n_lines, r.licenses) for r in license_scan(df).collect())
    assert got == [(0, 1, "MIT"), (4, 1, "MIT"), (4, 1, "MIT"), (5, 2, "ISC")]


def test_menus_and_copied_lines_fail_but_single_headings_pass():
    menu = ["Home", "World news", "Sport and weather", "Sign in here now"]
    prose = "This is a sentence that says something, and ends."
    assert qr.line_faults([prose, *menu, prose]) == [None, *["navigation"] * 4, None]
    assert qr.line_faults(["A heading", prose, "Another heading", prose, "Two", "In a row", prose]) == [None] * 7
    copied = "Follow us, friends, today."
    assert qr.line_faults([copied, prose] * 4)[0] == "boilerplate" and qr.line_faults([copied, prose] * 3)[0] is None
    assert qr.line_faults(["word " * 21])[0] == "punctuation" and qr.line_faults(["word " * 20])[0] is None
    judged = qr.judge("\n".join([prose] * 3 + menu))
    assert judged[8] == 4 and judged[10] == "\n".join([prose] * 3)


def test_a_stated_expression_gives_each_of_its_licences(spark):
    model = fit_license_model([PROSE] * 5)
    texts = ["// SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: (MPL-2.0 AND BSD-2-Clause)", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT"]
    got = [sorted({x.family for x in r.found if x.confirmed}) for r in license_paragraphs(docs(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [["Apache-2.0", "MIT"], ["BSD", "MPL-2.0"], ["GPL-2.0"], ["MIT"]]
