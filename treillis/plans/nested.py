"""Queries of problem 7: the flat tables of collected records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treillis.operators import nested
from treillis.session import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "termes_jdm"), table(spark, d, "termes_jdm_brut")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.all_children(*_inputs(spark, d))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of records."""
    return nested.all_tables(*_inputs(spark, d))[""]


def _child(path: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        child = nested.all_tables(*_inputs(spark, d))[path]
        return child.withColumn("parent", F.array_join(F.transform("parent", lambda p: p.cast("string")), "/"))

    query.__doc__ = f"The child table of {path}."
    return query


def queries() -> dict:
    names = {"H": "p7_h", "TRT": "p7_trt", "SST": "p7_sst", "raffinements": "p7_raffinements", "diagnostic_singulier.H": "p7_diagnostic_h"}
    return {"p7_found": p7_found, "p7_records": p7_records, **{q: _child(path) for path, q in names.items()}}
