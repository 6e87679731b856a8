"""Named tables and readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Catalog:
    """Name -> location of the inputs and outputs of a project."""

    def __init__(self, spark: SparkSession, locations: Mapping[str, str]):
        self.spark = spark
        self.locations = dict(locations)

    def table(self, name: str) -> DataFrame:
        return scan_table(self.spark, self.locations[name])

    def register(self) -> None:
        """One temporary view per table, for SQL."""
        for name in self.locations:
            self.table(name).createOrReplaceTempView(name)


def scan_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV with a header. Give CSV a schema: inference reads it twice."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
