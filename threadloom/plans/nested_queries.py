"""Queries over nested payloads (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import nested
from threadloom.plans.registry import query
from threadloom.session import table


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.element_paths(table(spark, d, "source_payloads"))


@query("p6_flat_rows")
def p6_flat_rows(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_rows(table(spark, d, "source_payloads")).withColumn("fields", F.to_json("fields"))


@query("p6_concepts")
def p6_concepts(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "source_payloads"), "concepts[]", ["name", "type", "confidence"])
