"""Metrics as aggregates: everything is a sum, count or mean that combines before the shuffle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.scores import bce, focal_bce, sigmoid, slot_nll, softplus
from logweave.functions.vectors import cosine
from logweave.operators.numbering import dense_position
from logweave.operators.pinning import pin_table
from logweave.vocabulary import BLOCKED_SOURCES


def template_metrics(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted", seconds: float | None = None) -> DataFrame:
    """One row: rows, accuracy (equal in place), template_f1 (overlap of the two multisets), and rows a second if a time is given."""
    both = pairs.agg(F.count("*").alias("rows"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(gold).alias("actual"), F.count(predicted).alias("guessed"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(gold).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("t"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    same = each.where("t is not null").groupBy("t").agg(F.least(F.sum("g"), F.sum("p")).alias("both")).agg(F.coalesce(F.sum("both"), F.lit(0)).alias("both"))
    out = both.join(same, F.lit(True))
    f1 = F.when((F.col("actual") > 0) & (F.col("guessed") > 0), 2 * F.col("both") / (F.col("actual") + F.col("guessed"))).otherwise(0.0)
    rate = F.lit(0.0) if not seconds or seconds <= 0 else F.col("rows") / F.lit(float(seconds))
    return out.select("rows", F.coalesce("accuracy", F.lit(0.0)).alias("grouping_accuracy"), F.coalesce("accuracy", F.lit(0.0)).alias("parsing_accuracy"), f1.alias("template_f1"), f1.alias("variable_span_f1"), rate.alias("eps"))


def last_per_key(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of a key's last row."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def score_labels(predictions: DataFrame, labels: DataFrame, key: str = "record_id", score: str = "score", label: str = "label", order: list[str] | None = None) -> DataFrame:
    """One row: records_scored, accuracy_at_0_5, positive_labels over the ids that both have; repeated ids count once, the last by `order`.

    No id in common fails the job.
    """
    one = lambda df, v: last_per_key(df, key, v, order or [v])
    both = one(predictions, score).join(one(labels, label), key)
    n = F.count("*")
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("predictions and labels have no id in common")).cast("bigint"))
    return both.agg(checked.alias("records_scored"), F.avg(((F.col(score) >= 0.5) == (F.col(label) != 0)).cast("double")).alias("accuracy_at_0_5"), F.sum(F.col(label).cast("long")).alias("positive_labels"))


def _source_allowed(source: str, blocked: tuple[str, ...] = BLOCKED_SOURCES, starts: bool = False) -> None:
    low = source.lower()
    if not source or any(low.startswith(b) if starts else b in low for b in blocked):
        raise ValueError(f"nothing may be fitted on source {source!r}")


def fit_threshold(scores: DataFrame, source: str, score: str = "score", label: str = "label") -> DataFrame:
    """One row, threshold: the lowest score of a positive, 1.0 if there is none. Sources that only score are refused."""
    _source_allowed(source)
    return scores.agg(F.coalesce(F.min(F.when(F.col(label) != 0, F.col(score).cast("double"))), F.lit(1.0)).alias("threshold"))


def fit_calibration(scores: DataFrame, source: str, logit: str = "logit", label: str = "label", quantile: float = 0.995, exact: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by, temperature, threshold): the quantile of negatives' probabilities, 0.5 without negatives.

    The quantile is a sketch's, right to one in 100,000 of the ranks. With `exact`, every distinct value of a
    group is kept in one task's memory: for small groups.
    """
    _source_allowed(source, starts=True)
    p = F.when(F.col(label) == 0, sigmoid(F.col(logit).cast("double")))
    q = F.percentile(p, F.lit(quantile)) if exact else F.percentile_approx(p, quantile, 100_000)
    return scores.groupBy(*(by or [])).agg(F.lit(1.0).alias("temperature"), F.coalesce(q, F.lit(0.5)).alias("threshold"))


def loss_metrics(scored: DataFrame, label: str = "label", event: str = "event_logit", micro: str = "micro_logit", macro: str = "macro_logit", fused: str = "fused_logit") -> DataFrame:
    """One row: mean focal losses of the four logits, plain cross-entropy of the fused, and how far event and micro disagree."""
    y = F.col(label)
    return scored.agg(
        *[F.avg(focal_bce(F.col(c).cast("double"), y)).alias(n) for n, c in (("event", event), ("micro", micro), ("macro", macro), ("fused", fused))],
        F.avg(bce(F.col(fused).cast("double"), y)).alias("bce"), F.avg(F.abs(sigmoid(F.col(event)) - sigmoid(F.col(micro)))).alias("hierarchy"),
    )


def _softplus_series(terms: int) -> list[list[float]]:
    """For k below `terms` the coefficients, by power of sigmoid(d), of the k-th derivative of softplus at d over k!; the first, softplus itself, is left empty."""
    out, now = [[], [0.0, 1.0]], [0.0, 1.0]
    for k in range(2, terms):
        new = [0.0] * (len(now) + 1)
        for i, c in enumerate(now):  # (s^i)' = i s^i - i s^(i + 1)
            new[i] += i * c
            new[i + 1] -= i * c
        now = new
        out.append([c / math.factorial(k) for c in now])
    return out


#: Width of a cell of scores, terms of the series in it, and from where on softplus is its argument, or 0, to 1e-16.
CELL, TERMS, FAR = 0.5, 14, 37.0


def pairwise_ranking(scored: DataFrame, logit: str = "fused_logit", label: str = "label", batch: str | None = None, margin: float = 1.0) -> DataFrame:
    """(batch, ranking): mean softplus(margin - positive + negative) over all pairs of a batch; 0 if a side is empty.

    Pairs are never formed. Scores are cut into cells of width CELL, each with its moments, which
    combine before the shuffle. Two cells' pairs are a Taylor series of softplus in the distance from their middles,
    whose terms are products of moments; at less than half of CELL on either side the rest is below (CELL / pi) ** TERMS, about 1e-11 of a pair.
    Cells further apart than FAR need counts and sums alone, which are summed along the cells. So the cost is linear in the
    rows, with at most some 160 neighbours of each occupied cell. Rows whose logit is null or not finite are left out.
    """
    key = F.col(batch) if batch else F.lit(0)
    x = F.col(logit).cast("double")
    rows = scored.select(key.alias("named"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).alias("batch"), x.alias("x"), (F.col(label) != 0).alias("y"))
    good = rows.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    cells = good.withColumn("cell", F.floor(F.col("x") / CELL).cast("long"))
    off = F.col("x") - (F.col("cell") + 0.5) * CELL
    cells = cells.groupBy("batch", "y", "cell").agg(*[F.sum(F.pow(off, F.lit(float(k)))).alias(f"m{k}") for k in range(TERMS)], F.sum("x").alias("total"))
    cells = pin_table(cells, "score_cells")
    side = lambda y, p: cells.where("y" if y else "not y").select("batch", F.col("cell").alias(f"{p}cell"), *[F.col(f"m{k}").alias(f"{p}{k}") for k in range(TERMS)], F.col("total").alias(f"{p}total"))
    pos, neg = side(True, "p"), side(False, "n")
    # d of two cells' middles: margin + (ncell - pcell) * CELL
    low, high = (math.floor((e - margin) / CELL) for e in (-FAR, FAR))
    near = pos.withColumn("ncell", F.explode(F.sequence(F.col("pcell") + low, F.col("pcell") + high))).join(neg, ["batch", "ncell"])
    d = margin + (F.col("ncell") - F.col("pcell")) * CELL
    s = sigmoid(d)
    terms = [softplus(d) * F.col("p0") * F.col("n0")]
    for k, powers in enumerate(_softplus_series(TERMS)):
        if k:
            at = reduce(lambda acc, c: acc * s + c, reversed(powers), F.lit(0.0))
            # (n - p) ** k of the offsets, over all pairs
            terms.append(at * sum(((-1) ** j * math.comb(k, j) * F.col(f"p{j}") * F.col(f"n{k - j}") for j in range(k + 1)), F.lit(0.0)))
    close = near.groupBy("batch").agg(F.sum(sum(terms, F.lit(0.0))).alias("close"))
    # far above: each pair gives margin - p + n, from counts and sums of all negative cells above
    above = W.partitionBy("batch").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    ends = neg.select("batch", F.col("ncell").alias("at"), F.lit(0).alias("kind"), F.col("n0").alias("c"), F.col("ntotal").alias("t"), F.lit(0.0).alias("p"), F.lit(0.0).alias("pt")).unionByName(
        pos.select("batch", (F.col("pcell") + high + 1).alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("c"), F.lit(0.0).alias("t"), F.col("p0").alias("p"), F.col("ptotal").alias("pt")))
    summed = ends.select("batch", "kind", "p", "pt", F.sum("c").over(above).alias("c"), F.sum("t").over(above).alias("t")).where("kind = 1")
    far = summed.groupBy("batch").agg(F.sum((margin * F.col("p") - F.col("pt")) * F.col("c") + F.col("p") * F.col("t")).alias("far"))
    sizes = cells.groupBy("batch").agg((F.sum(F.when(F.col("y"), F.col("m0"))) * F.sum(F.when(~F.col("y"), F.col("m0")))).alias("pairs"))
    out = rows.select("named", "batch").distinct().join(sizes, "batch", "left").join(close, "batch", "left").join(far, "batch", "left")
    whole = F.coalesce("close", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))
    return out.select(F.col("named").alias("batch"), F.coalesce(F.when(F.col("pairs") > 0, whole / F.col("pairs")), F.lit(0.0)).alias("ranking"))


def mean_slot_nll(rows: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row: slot_nll, the mean over rows whose target isn't -100."""
    return rows.agg(F.coalesce(F.avg(slot_nll(F.col(logits), F.col(target))), F.lit(0.0)).alias("slot_nll"))


def inverse_margin(rows: DataFrame, pairs: list[tuple[int, int]], logits: str = "action_logits") -> DataFrame:
    """One row: margin, the mean over pairs of mean max(0, 1 - left + right) of an array of logits; 0 without pairs."""
    each = [F.avg(F.greatest(F.lit(0.0), 1 - F.get(logits, F.lit(a)) + F.get(logits, F.lit(b)))) for a, b in pairs]
    return rows.agg((sum(each, F.lit(0.0)) / max(1, len(each))).alias("margin"))


def cosine_contrast(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row: contrast, 1 less the mean cosine of paired vectors."""
    return rows.agg((1 - F.avg(cosine(F.col(left), F.col(right)))).alias("contrast"))


def mean_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, value): means over batches of (…, metric, value)."""
    return metrics.groupBy(*(by or []), "metric").agg(F.avg("value").alias("value"))


def alert_curve(scored: DataFrame, budgets: list[int], score: str = "score", label: str = "label", ties: list[str] | None = None) -> DataFrame:
    """(budget, recall): the share of positives among the `budget` highest scores, 0 without positives; equal scores go by `ties`.

    One order of all rows serves every budget; it is made by ranges.
    """
    placed = dense_position(scored.select(F.col(score).alias("__score"), (F.col(label) != 0).alias("__hit"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties or [])]), [F.col("__score").isNull(), -F.col("__score"), *[f"__t{i}" for i in range(len(ties or []))]], "__at")
    found = placed.agg(F.count_if("__hit").alias("p"), *[F.count_if(F.col("__hit") & (F.col("__at") < b)).alias(f"b{i}") for i, b in enumerate(budgets)])
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"b{i}").alias("hit")) for i, b in enumerate(budgets)])
    return found.select("p", F.explode(each).alias("e")).select("e.budget", F.coalesce(F.col("e.hit") / F.nullif("p", F.lit(0)), F.lit(0.0)).alias("recall"))


def label_rule(frames: DataFrame, actor: Column, contains: str) -> DataFrame:
    """Adds label 1 where the actor's name contains a text: for synthetic data."""
    return frames.withColumn("label", F.coalesce(actor.contains(contains), F.lit(False)).cast("int"))
