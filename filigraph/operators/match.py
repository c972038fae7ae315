"""Pattern matching as joins: hops, optional hops, existence, and collections per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hop(left: DataFrame, key: str, edges: DataFrame, right: DataFrame, right_key: str, reverse: bool = False) -> DataFrame:
    """``left`` joined along ``edges`` to ``right``; against their direction with ``reverse``. Spark picks the join."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    way = edges.withColumnRenamed(near, "_near").withColumnRenamed(far, "_far")
    return left.join(way, left[key] == way["_near"]).join(right, F.col("_far") == right[right_key]).drop("_near", "_far")


def optional_collection(left: DataFrame, key: str, edges: DataFrame, reverse: bool = False, **aggregates: Column) -> DataFrame:
    """``left`` with aggregates over the edges of each row, null where it has none.

    Edges are aggregated before the join, so several optional hops never multiply each other's rows.
    """
    near = "dst" if reverse else "src"
    per = edges.groupBy(F.col(near).alias("_near")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return left.join(per, left[key] == per["_near"], "left").drop("_near")


def optional_count(left: DataFrame, key: str, edges: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """``left`` with the number of distinct neighbours of each row, zero where it has none."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    counted = optional_collection(left, key, edges.select(near, far), reverse, **{name: F.count_distinct(far)})
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))


def having(left: DataFrame, key: str, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """The rows of ``left`` that have such an edge."""
    near = "dst" if reverse else "src"
    return left.join(edges.select(F.col(near).alias(key)), key, "left_semi")


def lacking(left: DataFrame, key: str, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """The rows of ``left`` that have no such edge; rows with a null key have none."""
    near = "dst" if reverse else "src"
    return left.join(edges.select(F.col(near).alias(key)), key, "left_anti")


def flagged(left: DataFrame, pair: tuple[str, str], edges: DataFrame, name: str) -> DataFrame:
    """``left`` with a boolean: does an edge lead from the first column of ``pair`` to the second."""
    there = edges.select(F.col("src").alias(pair[0]), F.col("dst").alias(pair[1]), F.lit(True).alias(name)).distinct()
    return left.join(there, list(pair), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at a node in either direction, a loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def first_few(values: Column, n: int) -> Column:
    """The n alphabetically first distinct values of a group."""
    return F.slice(F.array_sort(F.collect_set(values)), 1, n)
