"""Stored models, predictions and measures, as Parquet tables."""
from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(frame: DataFrame, path: str, *by: str) -> None:
    """Writes a table (signatures, nodes, predictions, measures), partitioned by the given columns."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Model:
    """What learning gives: signatures, the sides and phrases of the training examples, and the trees over them.

    A node's symbols are the sums over its leaves (clustering.node_symbols), so that a stored tree can be descended."""

    signatures: DataFrame
    leaves: DataFrame
    examples: DataFrame
    nodes: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            save(getattr(self, f.name), f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(*[load(spark, f"{path}/{f.name}") for f in fields(cls)])


def save_confusion(matrix: DataFrame, path: str) -> None:
    """A confusion matrix as one CSV with the published first header."""
    matrix.orderBy("attendu").withColumnRenamed("attendu", "attendu \\ prédit").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def complete_measures(measures: DataFrame, n_seeds: int, n_folds: int) -> DataFrame:
    """Measures of configurations of which all seeds and folds are there."""
    whole = measures.groupBy("cle").agg(F.count_distinct("graine", "pli").alias("n")).filter(F.col("n") == n_seeds * n_folds).select("cle")
    return measures.join(whole, "cle", "left_semi")


def missing_tasks(keys: DataFrame, seeds: list[int], folds: int, done: DataFrame) -> DataFrame:
    """(cle, graine, pli) still to be measured."""
    each = keys.select("cle", F.explode(F.array(*map(F.lit, seeds))).alias("graine")).select("cle", "graine", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("pli"))
    return each.join(done.select("cle", "graine", "pli"), ["cle", "graine", "pli"], "left_anti")


def stored_value(spark: SparkSession, path: str, field: str):
    """One value of a stored JSON result, e.g. ``macro_stricte.f1``."""
    row = spark.read.option("multiLine", True).json(path).select(field).first()
    return None if row is None else row[0]


def with_ad_hoc(records: DataFrame, ad_hoc: DataFrame) -> DataFrame:
    """Collected records and those fetched on demand for other terms; collected ones hold."""
    return records.unionByName(ad_hoc.join(records.select("terme"), "terme", "left_anti"), allowMissingColumns=True)
