"""Licence scans: a trained paragraph classifier names the family, templates confirm it.

A paragraph is a line, or a notice wrapped over several: lines on end of whose word pairs most are
known from licences are joined, but a line that covers a template by itself stays one. A multinomial logistic regression on sparse word 1- to 3-grams gives a
probability for each licence family and for unknown. It is trained here, on variants of the
templates (cut, thinned, with strange words around) against text that is none: words strung together
from the corpus's own paragraphs, and licence words out of order. A temperature, fitted on held-out
variants, calibrates the probabilities; what no family reaches with enough of it is unknown. A
prediction counts as confirmed if enough of the paragraph's or template's word pairs are in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.llm.license_templates import TEMPLATES
from logweave.llm.sampling import hash_sample
from logweave.operators.pinning import pin

UNKNOWN = "unknown"
#: Bounds of what the classifier is fitted on: sampled corpus rows and lines of them, and variants made of each template.
MAX_SAMPLE_DOCS, MAX_SAMPLE_LINES, VARIANTS = 200, 1200, 60
MIN_PROBABILITY, MIN_OVERLAP, MIN_SHARED = 0.6, 0.5, 2
#: Share of a line's word pairs that makes it part of a notice, and of a template's that makes a line a whole one.
PART_OF_NOTICE, WHOLE_NOTICE = 0.5, 0.9
#: The word before a stated expression of licences, and those that join them in it.
TAG, JOINERS = b"spdx-license-identifier", (b"or", b"and", b"with")
_word = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*")


def words_of(paragraph: bytes) -> list[bytes]:
    return _word.findall(paragraph.lower())


def grams_of(words: list[bytes], known: dict[bytes, int]) -> list[int]:
    """Numbers of the known 1- to 3-grams. Only n-grams of known words are looked up, as `known` has no others."""
    found = []
    get, n = known.get, len(words)
    for i, w in enumerate(words):
        a = get(w)
        if a is None:
            continue
        found.append(a)
        if i + 1 < n and (b := get(w + b" " + words[i + 1])) is not None:
            found.append(b)
            if i + 2 < n and (c := get(b" ".join(words[i : i + 3]))) is not None:
                found.append(c)
    return found


def pairs_of(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:], strict=False))


def overlap(pairs: frozenset, template: frozenset) -> float:
    """Share of the smaller set's word pairs that both have; 0 with fewer than MIN_SHARED in common, or all of a template that has fewer."""
    both = len(pairs & template)
    return both / min(len(pairs), len(template)) if both >= min(MIN_SHARED, len(template)) and both else 0.0


@dataclass
class LicenseModel:
    """What fit_license_model has learned: n-gram numbers, weights (n-grams x families), bias, temperature, templates' word pairs."""

    families: list[str]
    known: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[list[frozenset]]

    def logits(self, grams: list[int]) -> np.ndarray:
        if not grams:
            return self.bias
        each = np.unique(np.asarray(grams))
        return self.bias + self.weights[each].sum(axis=0) / np.sqrt(len(each))

    def probabilities(self, grams: list[int]) -> np.ndarray:
        z = self.logits(grams) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def kind_of_line(self, words: list[bytes]) -> str:
        """'' for a line without a known word, 'part' for a piece of a notice, else 'line'."""
        if self.known.keys().isdisjoint(words):
            return ""
        if sum(w in self.known for w in words) < PART_OF_NOTICE * len(words):
            return "line"
        pairs = pairs_of(words)
        if not pairs or sum(b" ".join(p) in self.known for p in pairs) < PART_OF_NOTICE * len(pairs):
            return "line"
        whole = any(len(pairs & t) >= WHOLE_NOTICE * len(t) for ts in self.templates for t in ts if t)
        return "line" if whole else "part"

    def paragraphs(self, lines: list[bytes]) -> list[tuple[int, list[bytes]]]:
        """(number of its first line, words) of each paragraph with a known word: pieces of a notice on end are one."""
        out: list[tuple[int, list[bytes]]] = []
        inside = False
        for k, line in enumerate(lines):
            words = words_of(line)
            kind = self.kind_of_line(words)
            if kind == "part" and inside:
                out[-1][1].extend(words)
            elif kind:
                out.append((k, words))
            inside = kind == "part"
        return out

    def licences(self, words: list[bytes]) -> list[tuple[str, float, float, bool]]:
        """As classify, once for each licence that a stated expression joins by or, and, with; else once."""
        if TAG not in words:
            return [self.classify(words)]
        operands: list[list[bytes]] = [[]]
        for w in words[words.index(TAG) + 1 :]:
            if w in JOINERS:
                operands.append([])
            else:
                operands[-1].append(w)
        return [self.classify([TAG, *o]) for o in operands] if len(operands) > 1 else [self.classify(words)]

    def classify(self, words: list[bytes]) -> tuple[str, float, float, bool]:
        """(family, its probability, overlap with its closest template, confirmed)."""
        p = self.probabilities(grams_of(words, self.known))
        k = int(p[:-1].argmax())
        if p[k] < MIN_PROBABILITY:
            return UNKNOWN, float(p[-1]), 0.0, False
        pairs = pairs_of(words)
        shared = max(overlap(pairs, t) for t in self.templates[k])
        return self.families[k], float(p[k]), shared, shared >= MIN_OVERLAP


def _variant(words: list[bytes], strange: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """The words cut at either end, some left out, with strange ones around: as notices are found in the wild."""
    n = len(words)
    if n > 12 and rng.random() < 0.5:
        size = int(rng.integers(max(8, n // 3), n + 1))
        start = int(rng.integers(0, n - size + 1))
        words = words[start : start + size]
    keep = rng.random(len(words)) > (0.08 if len(words) > 8 else 0.0)
    around = [strange[k] for k in rng.integers(0, len(strange), int(rng.integers(0, 8)))] if strange and rng.random() < 0.5 else []
    cut = int(rng.integers(0, len(around) + 1))
    return around[:cut] + [w for w, k in zip(words, keep, strict=True) if k] + around[cut:]


def fit_license_model(sample: list[str], seed: int = 5, epochs: int = 12, batch: int = 64) -> LicenseModel:
    """Fits on the templates and on `sample`, a bounded list of texts or lines that stand for what isn't a licence. The same input gives the same model.

    A model that takes a paragraph without any known word for a licence is refused, as the scan passes over those.
    """
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    texts = [(k, words_of(t.encode())) for k, f in enumerate(families[:-1]) for t in TEMPLATES[f]]
    grams = sorted({b" ".join(w[i : i + n]) for _, w in texts for n in (1, 2, 3) for i in range(len(w) - n + 1)})
    known = {g: i for i, g in enumerate(grams)}
    licence_words = [w for _, ws in texts for w in ws]
    lines = [w for t in sample for line in t.split("\n") if (w := words_of(line.encode("utf-8", "surrogatepass")))]
    lines = [w for w in lines if not any(overlap(pairs_of(w), pairs_of(t)) >= MIN_OVERLAP for _, t in texts)]
    strange = sorted({w for line in lines for w in line})
    rows, classes = [], []
    for k, w in texts:
        for _ in range(VARIANTS):
            rows.append(grams_of(_variant(w, strange, rng), known))
            classes.append(k)
    unknown = [grams_of(w, known) for w in lines] + [[]]
    for _ in range(VARIANTS * len(families)):  # licence words that mean nothing together, few or many
        mixed = [licence_words[k] for k in rng.integers(0, len(licence_words), int(rng.integers(1, 12)))]
        unknown.append(grams_of(mixed + [strange[k] for k in rng.integers(0, len(strange), 5)] if strange else mixed, known))
    rows += unknown
    classes += [len(families) - 1] * len(unknown)
    order = rng.permutation(len(rows))
    held = set(order[: len(order) // 5].tolist())
    weights, bias = np.zeros((len(grams), len(families))), np.zeros(len(families))
    squares, bias_squares = np.full_like(weights, 1e-2), np.full_like(bias, 1e-2)
    model = LicenseModel(families, known, weights, bias, 1.0, [[pairs_of(words_of(t.encode())) for t in TEMPLATES[f]] for f in families[:-1]])
    prepared, target = [np.unique(np.asarray(r, np.int64)) for r in rows], np.asarray(classes)
    train = np.array([i for i in range(len(rows)) if i not in held])
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            lengths = np.array([len(prepared[i]) for i in part])
            g, of = np.concatenate([prepared[i] for i in part]), np.repeat(np.arange(len(part)), lengths)
            scale = (1 / np.sqrt(np.maximum(1, lengths)))[of, None]
            z = np.tile(bias, (len(part), 1))
            np.add.at(z, of, weights[g] * scale)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            e[np.arange(len(part)), target[part]] -= 1
            bias_squares += e.sum(axis=0) ** 2
            bias -= 0.3 * e.sum(axis=0) / np.sqrt(bias_squares)
            step = np.zeros_like(weights)
            np.add.at(step, g, e[of] * scale)
            squares += step * step
            weights -= 0.3 * step / np.sqrt(squares) + 1e-5 * weights
    tested = [(model.logits(rows[i]), classes[i]) for i in sorted(held)]

    def loss(t: float) -> float:
        return sum(float(np.log(np.exp((z - z.max()) / t).sum()) - (z[c] - z.max()) / t) for z, c in tested)

    model.temperature = min((float(t) for t in np.geomspace(0.25, 8, 26)), key=loss)
    if model.classify([])[0] != UNKNOWN:
        raise ValueError("a paragraph without known words must be unknown")
    return model


def license_paragraphs(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, found) for every row: found is an array of (line, family, probability, overlap, confirmed), by a paragraph's first line, from 0.

    A paragraph in prose has one family, the most probable; a stated expression has one for each licence that it joins.

    Null and empty texts are one line in which nothing is found. Ids may be null or repeat, and rows that
    repeat each have a row, in which the same is found. Whole texts are read, however long they or their
    lines are. Other columns of `docs`, whatever their names, play no part.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the templates
    kind = "array<struct<line:int,family:string,probability:double,overlap:double,confirmed:boolean>>"
    arrow = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())]))

    def scan(text: bytes | None, m: LicenseModel) -> tuple[int, list[dict]]:
        lines = (text or b"").split(b"\n")
        out = []
        for k, words in m.paragraphs(lines):
            for family, p, share, sure in m.licences(words):
                if family != UNKNOWN:
                    out.append({"line": k, "family": family, "probability": p, "overlap": share, "confirmed": sure})
        return len(lines), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small(batches, 1):
            rows = [scan(t, m) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], arrow)], ["doc_id", "n_lines", "found"])

    return base.mapInArrow(run, f"doc_id bigint, n_lines bigint, found {kind}")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_sample: int = MAX_SAMPLE_DOCS, max_lines: int = MAX_SAMPLE_LINES) -> DataFrame:
    """doc_id, n_lines, n_found, n_confirmed, licenses (distinct confirmed families, sorted, comma-joined; '' if none), probability (highest of a confirmed one, else 0).

    The model is fitted on the templates and on at most `max_lines` different lines of at most `max_sample`
    rows, in both those whose hashes are lowest. An empty table gives an empty result. Null ids, repeated
    rows, long texts and other columns are as in license_paragraphs.
    """
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    lines = pin(hash_sample(texts, ["id"], max_sample, 11).select(F.explode(F.split("t", "\n")).alias("t")).distinct())
    sample = hash_sample(lines, ["t"], max_lines, 11).orderBy("t").collect()
    found = license_paragraphs(docs, fit_license_model([r.t for r in sample]), id_col, text)
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_lines", F.size("found").cast("long").alias("n_found"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licenses"), F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
