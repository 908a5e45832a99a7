"""Classifier families on vector rows: Spark ML estimators behind one registry.

A family is a function from (parameters, seed) to an ML ``Estimator`` and the
kind of score it gives.  The RBF machine is a linear SVM on random Fourier
features, the boosted and dense models use Spark's own algorithms; see README
for how they differ from their single-machine counterparts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .moments import stack
from .reliability import cut_point

RFF_WIDTH = 256


def as_vectors(rows: DataFrame, vector: str = "z") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def l1_logistic(c: float = 0.5, n_weight: float = 1.0, max_iter: int = 500) -> LogisticRegression:
    """L1 logistic with the objective |w|_1 + C * sum of weighted losses."""
    return LogisticRegression(
        regParam=1.0 / (c * n_weight), elasticNetParam=1.0, standardization=False, weightCol="weight", maxIter=max_iter, tol=1e-9
    )


def estimator(family: str, parameter: float, width: int, n_rows: int, seed: int = 42, forest_depth: int = 8, net_steps: int = 50):
    """Spark ML estimator of a family at one point of its grid, for ``n_rows`` training rows.

    The SVC's C weighs the sum of the losses, Spark's penalty their mean: the penalty is 1 / (C n).
    """
    if family == "rbf_svc_decision":
        return LinearSVC(regParam=1.0 / (max(parameter, 1e-6) * max(1, n_rows)), maxIter=100, standardization=False)
    if family == "random_forest_bagged":
        return RandomForestClassifier(numTrees=200, featureSubsetStrategy="sqrt", minInstancesPerNode=int(parameter), maxDepth=forest_depth, seed=seed)
    if family == "hist_gradient_boosting":
        return GBTClassifier(maxIter=100, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, minInfoGain=parameter * 1e-4, seed=seed)
    if family == "dense_net":
        return MultilayerPerceptronClassifier(layers=[width, 128, 2], maxIter=net_steps, seed=seed)
    raise ValueError(f"unknown family {family!r}")


def fourier_features(rows: DataFrame, width: int, variance: float, seed: int = 42, vector: str = "z", components: int = RFF_WIDTH) -> DataFrame:
    """Replace ``z`` by cosine features whose inner product approximates exp(-gamma |a-b|^2), gamma = 1/(d var)."""
    gamma = 1.0 / (width * max(variance, 1e-12))
    rng = np.random.Generator(np.random.Philox(key=seed))
    omega = rng.standard_normal((width, components)) * math.sqrt(2.0 * gamma)
    phase = rng.uniform(0.0, 2.0 * math.pi, components)
    shared = rows.sparkSession.sparkContext.broadcast((omega, phase))  # width x components doubles
    keep = [c for c in rows.columns if c != vector]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != vector)

    def run(batches):
        w, b = shared.value
        for pdf in batches:
            if len(pdf):
                f = math.sqrt(2.0 / components) * np.cos(stack(pdf[vector]) @ w + b)
                yield pdf[keep].assign(**{vector: list(f)})

    return rows.select(*keep, vector).mapInPandas(run, f"{types}, {vector} array<double>")


def fit_score(train: DataFrame, held: DataFrame, family: str, parameter: float, seed: int = 42):
    """Fit on train rows, score held-out rows: ``(sample_id, y, score, score_type)`` oriented to class 1."""
    width = train.select(F.size("z").alias("d")).first()["d"]
    if family == "rbf_svc_decision":
        variance = train.select(F.explode("z").alias("x")).agg(F.var_pop(F.col("x").cast("double"))).first()[0]
        train, held = (fourier_features(df.select("sample_id", "y", "z"), width, variance, seed) for df in (train, held))
    model = estimator(family, parameter, width, train.count(), seed).fit(as_vectors(train).withColumn("label", F.col("y").cast("double")))
    out = model.transform(as_vectors(held))
    if family == "rbf_svc_decision":
        score, kind = vector_to_array("rawPrediction")[1], "decision"
    else:
        score, kind = vector_to_array("probability")[1], "probability"
    return out.select("sample_id", "y", score.alias("score"), F.lit(kind).alias("score_type")), model


def adapt_scores(scored: DataFrame) -> DataFrame:
    """Common form of all families: cut by score type and predicted label."""
    cut = cut_point(F.col("score_type"))
    return scored.withColumn("cut", cut).withColumn("predicted", (F.col("score") >= cut).cast("int"))
