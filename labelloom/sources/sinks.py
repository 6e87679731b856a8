"""Writers for scored tables, result tables and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, one file per partition, no index column."""
    df.write.option("header", True).mode("overwrite").csv(path)
    return path


def write_results(results: DataFrame, path: str, run: str = "run") -> str:
    """Typed result rows, one folder per run; writing a run again replaces only that run."""
    writer = results.write.partitionBy(run).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str, fold: int) -> str:
    target = f"{path}/fold={fold}"
    model.write().overwrite().save(target)
    return target


def load_model(path: str, fold: int) -> PipelineModel:
    return PipelineModel.load(f"{path}/fold={fold}")
