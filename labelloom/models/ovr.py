"""One model per class: fitting in parallel, scoring in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.models.batched import Linear, fit_logistic, packed, scored
from labelloom.roles import named

WORKERS = 8  # jobs in flight; each one still spreads over the whole cluster


def in_pool(spark, tasks: Sequence[Callable[[], object]], workers: int = WORKERS) -> list:
    """Run independent Spark jobs from a few driver threads, each in its own FAIR pool."""
    sc = spark.sparkContext

    def run(numbered):
        i, task = numbered
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{i % workers}")
        try:
            return task()
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(run, enumerate(tasks)))


def fit_ovr(train: DataFrame, classes: Sequence[str], strengths: Sequence[float], tol: float = 1e-8) -> Linear:
    """A logistic model per 0/1 class column of ``train`` (features, classes), each with its own strength; all are
    fitted by the same passes."""
    rows = train.select(F.lit(0).alias("part"), vector_to_array("features").alias("x"), *[named(c) for c in classes])
    blocks = packed(rows, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_logistic(blocks, len(classes), [[s] for s in strengths], tol)
    finally:
        blocks.unpersist()


def score_ovr(df: DataFrame, model: Linear, name: str = "probs") -> DataFrame:
    """P(class) of all classes as one array: one matrix product per batch of rows."""
    kept = F.struct(*[named(c) for c in df.columns if c != "features"]).alias("row")
    rows = df.select(kept, F.lit(0).alias("part"), vector_to_array("features").alias("x"))
    return scored(rows, model, "p").select("row.*", F.col("p").alias(name))


def predictions_long(
    scored: DataFrame, key: str, classes: Sequence[str], probs: str = "probs"
) -> DataFrame:
    """(key, label, p) with only non-zero probabilities kept."""
    cells = F.transform(
        F.col(probs),
        lambda v, i: F.struct(
            F.get(F.array(*[F.lit(c) for c in classes]), i).alias("label"), v.alias("p")
        ),
    )
    return scored.select(key, F.inline(cells)).filter(F.col("p") != 0)
