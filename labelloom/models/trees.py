"""Tree ensembles on MLlib, with the parameter names users of the search grid know."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

MAX_DEPTH = 30  # MLlib's limit


def allowed_depth(max_depth: int) -> int:
    """The depth; one that MLlib cannot train is rejected before any job."""
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} is beyond MLlib's limit of {MAX_DEPTH}")
    return max_depth


def forest(
    n_estimators: int = 120,
    max_depth: int = 8,
    min_samples_split: int = 2,
    min_samples_leaf: int = 1,
    max_features: str = "log2",
    seed: int = 0,
    label: str = "y",
) -> RandomForestClassifier:
    """Random forest. MLlib has no split-size limit; it is implied while
    min_samples_split <= 2 * min_samples_leaf and rejected otherwise."""
    if min_samples_split > 2 * min_samples_leaf:
        raise ValueError("min_samples_split beyond 2 * min_samples_leaf has no counterpart")
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=n_estimators,
        maxDepth=allowed_depth(max_depth),
        minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy=max_features,
        seed=seed,
    )


def single_tree(
    max_depth: int = 8,
    min_samples_split: int = 2,
    min_samples_leaf: int = 1,
    max_features: str = "log2",
    seed: int = 0,
    label: str = "y",
) -> RandomForestClassifier:
    """One tree with a random feature subset per node: a forest of one, no resampling."""
    model = forest(1, max_depth, min_samples_split, min_samples_leaf, max_features, seed, label)
    return model.setBootstrap(False)


def boosted(
    learning_rate: float = 0.1,
    gamma: float = 0.0,
    max_depth: int = 6,
    min_child_weight: int = 1,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    reg_lambda: float = 0.0,
    reg_alpha: float = 0.0,
    n_estimators: int = 100,
    seed: int = 0,
    label: str = "y",
) -> GBTClassifier:
    """Gradient-boosted trees. The leaf penalties (lambda, alpha) have no
    counterpart in MLlib: they are ignored with a warning."""
    if reg_lambda or reg_alpha:
        warnings.warn("boosted: reg_lambda and reg_alpha are ignored", stacklevel=2)
    return GBTClassifier(
        featuresCol="features",
        labelCol=label,
        stepSize=learning_rate,
        minInfoGain=gamma,
        maxDepth=allowed_depth(max_depth),
        minInstancesPerNode=max(1, int(min_child_weight)),
        subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample_bytree),
        maxIter=n_estimators,
        seed=seed,
    )
