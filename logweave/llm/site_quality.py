"""Document quality by hierarchical empirical Bayes over sites.

1. A logistic regression on counts of a text says how likely the document is good, from itself alone.
2. Sites are two levels, host and path below it. Each site's rate is the mean of its documents'
   evidence: the label where there is one, else the classifier's probability. Grouped sums are all
   that is needed. How far sites differ, beyond chance, gives the strength of the prior (method of
   moments), and sparse sites shrink: path to host, host to the global rate.
3. A document's posterior odds are its own likelihood ratio times its path's prior odds, with its own
   evidence taken out of the site's sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.llm.sampling import hash_sample
from logweave.operators.pinning import pin

FEATURES = ("log_words", "word_chars", "symbol_share", "upper_share", "bang_share", "digit_share", "bar_share", "distinct_share", "stop_share", "line_words", "pair_share")
MAX_TRAIN = 20_000
_letters, _upper, _digits, _symbols = (re.compile(p) for p in (rb"[A-Za-z\x80-\xff]", rb"[A-Z]", rb"[0-9]", rb"[#*$%&|<>]"))
_delete = {p: bytes(c for c in range(256) if p.match(bytes([c]))) for p in (_letters, _upper, _digits, _symbols)}


def text_features(raw: bytes | None) -> list[float]:
    """FEATURES of a text: scale-free counts. A null text is an empty one, all zeros."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters, upper, digits, symbols = (len(raw) - len(raw.translate(None, d)) for d in _delete.values())
    pairs = set(zip(words, words[1:], strict=False))
    return [
        float(np.log(n)), min(sum(map(len, words)) / n, 40.0), symbols / len(raw), upper / max(letters, 1), (raw.count(b"!") + raw.count(b"?")) / n, digits / len(raw),
        words.count(b"|") / n, len(set(words)) / n, min((raw.count(b".") + raw.count(b",")) / n, 2.0), float(np.log1p(n / (raw.count(b"\n") + 1))), len(pairs) / max(n - 1, 1),
    ]


def features(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    base = docs.select(F.col(text).cast("string").alias("__text"), *carry)
    rest = base.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = np.array([text_features(t) for t in utf8(b.column(0))], np.float64).reshape(-1)
            values = pa.FixedSizeListArray.from_arrays(pa.array(found), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], values], [f.name for f in rest] + ["features"])

    return base.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["features array<double>"]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(weights, bias) on raw features, by Newton's method with a ridge on standardised ones. Without two classes: no weights, smoothed odds."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(FEATURES)), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return p / (1 - p)


def _strength(sites: DataFrame, mean: str, prior: str) -> float:
    """How many documents the prior of a level counts for: from the spread of its sites' rates around their priors, less the spread by chance.

    One row comes to the driver. No sites, or none that differ beyond chance: a strong prior.
    """
    chance = F.col(prior) * (1 - F.col(prior))
    row = sites.agg(F.sum(F.col("n") * F.pow(F.col(mean) - F.col(prior), 2)).alias("spread"), F.sum(chance).alias("chance"), F.sum(F.col("n") * chance).alias("whole"), F.count("*").alias("k")).first()
    if not row.k or not row.whole:
        return 1e4
    between = (row.spread - row.chance) / row.whole  # share of the variance that lies between sites
    return min(1e4, max(1.0, (1 - between) / between)) if between > 0 else 1e4


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_doc, host_rate, path_rate, quality (the posterior), kept (quality >= threshold) for every row of `docs`.

    `labels` has (id, 0 or 1); null labels don't count, and several of an id are averaged. The
    classifier fits on at most `max_train` labelled rows, those with the smallest hashes; all else
    covers all rows. Null hosts and paths are sites of their own. Rows with null ids have no label.
    Null and empty texts have all features zero. Repeated rows count each. An empty table gives an
    empty result.
    """
    known = pin(labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label).alias("y")))
    rows = pin(features(docs, text, [F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")]))
    joined = pin(rows.join(known, "doc_id", "left"))
    train = hash_sample(joined.where("y is not null").select("doc_id", "features", "y"), ["doc_id", "features"], max_train, 3).collect()
    x, y = np.array([r.features for r in train], float).reshape(-1, len(FEATURES)), np.array([r.y for r in train], float)
    weights, bias = fit_logistic(x, (y >= 0.5).astype(float))
    dot = sum((F.col("features")[i] * float(w) for i, w in enumerate(weights)), F.lit(bias))
    scored = joined.select("doc_id", "host", "path", "y", (1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), dot))))).alias("p_doc")).withColumn("e", F.coalesce("y", "p_doc"))
    paths = pin(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s")))
    hosts = pin(paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = ((s or 0.0) + 1) / ((n or 0) + 2)
    k_host = _strength(hosts.withColumns({"m": F.col("s") / F.col("n"), "prior": F.lit(rate)}), "m", "prior")
    hosts = pin(hosts.withColumn("h_rate", (F.col("s") + k_host * rate) / (F.col("n") + k_host)).withColumnsRenamed({"n": "h_n", "s": "h_s"}))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h")
    k_path = _strength(both.withColumn("m", F.col("s") / F.col("n")), "m", "h_rate")
    sites = pin(both.withColumnsRenamed({"host": "s_host", "path": "s_path"}))
    out = scored.join(sites, scored["host"].eqNullSafe(sites["s_host"]) & scored["path"].eqNullSafe(sites["s_path"]))
    host_rate = (F.col("h_s") - F.col("e") + k_host * rate) / (F.col("h_n") - 1 + k_host)
    path_rate = (F.col("s") - F.col("e") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = out.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    odds = _odds(F.col("p_doc")) / _odds(F.lit(rate)) * _odds(F.col("path_rate"))
    return out.withColumn("quality", odds / (1 + odds)).select("doc_id", "p_doc", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))
