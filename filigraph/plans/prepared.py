"""Queries of the numbered general problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filigraph.operators.split_values import split_values
from filigraph.operators.units import converted_quantities
from filigraph.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 1: the values packed in product descriptions and executive titles."""
    products = split_values(table(spark, folder, "products"), "productid", "description", "products")
    executives = split_values(table(spark, folder, "executives"), "executiveid", "title", "executives", offices=True)
    return products.unionByName(executives)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 7: every stated quantity in the common unit of its kind."""
    return converted_quantities(table(spark, folder, "financial_metrics"), table(spark, folder, "fx_rates"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (p1_found, p7_found)}
