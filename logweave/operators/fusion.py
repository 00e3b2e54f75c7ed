"""Scores of several heads, fitted with Spark ML: event, micro and macro window, fused; and of window links."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.scores import decays
from logweave.functions.vectors import pair_features

HEADS = {"event": ["__embedding"], "micro": ["__embedding", "graph_score"], "macro": ["__embedding", "graph_score", "long_horizon_score"]}


def _stages(ridge: float, rounds: int) -> list:
    stages = []
    for name, inputs in [*HEADS.items(), ("fused", [f"{h}_logit" for h in HEADS])]:
        if name == "fused":  # the heads' logits come out of vectors
            stages.append(VectorAssembler(inputCols=[f"__{h}_raw" for h in HEADS], outputCol="__fused_x"))
        else:
            stages.append(VectorAssembler(inputCols=inputs, outputCol=f"__{name}_x"))
        stages.append(LogisticRegression(featuresCol=f"__{name}_x", labelCol="label", rawPredictionCol=f"__{name}_raw", probabilityCol=f"__{name}_p", predictionCol=f"__{name}_y", regParam=ridge, maxIter=rounds))
    return stages


def _inputs(features: DataFrame, embedding: str) -> DataFrame:
    return features.withColumn("__embedding", array_to_vector(F.col(embedding).cast("array<double>"))).fillna(0.0, ["graph_score", "long_horizon_score"])


def fit_fusion(features: DataFrame, embedding: str = "event_embedding", ridge: float = 0.01, rounds: int = 25) -> PipelineModel:
    """Four logistic heads over features with event embedding, graph_score, long_horizon_score and label."""
    return Pipeline(stages=_stages(ridge, rounds)).fit(_inputs(features, embedding))


def apply_fusion(model: PipelineModel, features: DataFrame, embedding: str = "event_embedding") -> DataFrame:
    """Adds event_logit, micro_logit, macro_logit, fused_logit and score, the fused probability."""
    out = model.transform(_inputs(features, embedding))
    logits = {f"{h}_logit": vector_to_array(f"__{h}_raw")[1] for h in [*HEADS, "fused"]}
    return out.withColumns(logits | {"score": vector_to_array("__fused_p")[1]}).select(*features.columns, *logits, "score")


def link_inputs(links: DataFrame, source: Column, target: Column) -> DataFrame:
    """Adds pair_features of two embeddings and the link's evidence."""
    evidence = F.array(*[F.col(c).cast("double") for c in ("anchor_score", "stable_rarity", "action_compatibility", "path_coherence", "graph_cosine")])
    return links.withColumn("pair_features", pair_features(source, target, decays(F.col("delta_seconds")), evidence))


def fit_link_scores(labeled: DataFrame, ridge: float = 0.01, rounds: int = 50) -> PipelineModel:
    """A logistic regression on pair_features and label."""
    return Pipeline(stages=[LogisticRegression(featuresCol="__x", labelCol="label", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__y", regParam=ridge, maxIter=rounds)]).fit(labeled.withColumn("__x", array_to_vector("pair_features")))


def apply_link_scores(model: PipelineModel, links: DataFrame) -> DataFrame:
    out = model.transform(links.withColumn("__x", array_to_vector("pair_features")))
    return out.withColumn("score", vector_to_array("__p")[1]).drop("__x", "__raw", "__p", "__y")


def weighted_fusion(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score, a weighted mean of columns: the baseline without learning."""
    return scores.withColumn("score", sum((w * F.col(c).cast("double") for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()))
