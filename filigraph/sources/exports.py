"""Exports of the graph: which rows go out, in what form, and under what ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_filers(edges: DataFrame, filed: DataFrame) -> DataFrame:
    """Edges (src, dst) that start at a company which has filed something."""
    return edges.join(filed.select("src"), "src", "left_semi")


def entity_rows(nodes: DataFrame, edges: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct rows of the nodes that ``edges`` lead to, nulls as ``''``; nodes without a name stay behind."""
    reached = nodes.join(edges.select(F.col("dst").alias(key)), key, "left_semi")
    named = reached.filter(F.col(columns[0]).isNotNull() & (F.col(columns[0]) != ""))
    return named.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns)).distinct()


def name_binding(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key): the id that edges of a name are bound to, the last one where the name has several rows."""
    return rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.max(key).alias(key))


def junction(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges re-keyed from names to ids by two bindings (name, id); edges without a binding are dropped."""
    a, b = left.toDF("src", "left_id"), right.toDF("dst", "right_id")
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("left_id", "right_id").distinct()


def typed_mentions(mentions: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, src, dst) of several mention frames."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("entity_type"), "src", "dst") for label, df in mentions.items()])


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def after_marker(path: Column, marker: str) -> Column:
    """What follows ``marker`` in a path, the whole path where it is absent."""
    return F.when(F.contains(path, F.lit(marker)), F.substring_index(path, marker, -1)).otherwise(path)


def entity_snapshot(entities: DataFrame, n_chunks: int = 3) -> DataFrame:
    """Entities with public labels and properties only and at most ``n_chunks`` distinct chunks, alphabetical."""
    public = lambda c: ~c.startswith("__")
    return entities.select(
        "element_id", F.coalesce("name", F.lit("")).alias("name"), F.filter("labels", public).alias("labels"), F.map_filter("properties", lambda k, v: public(k) & v.isNotNull()).alias("properties"),
        F.slice(F.array_sort(F.array_distinct(F.array_compact(F.coalesce("source_chunks", F.array().cast("array<string>"))))), 1, n_chunks).alias("source_chunks"), F.coalesce("relationship_count", F.lit(0)).alias("relationship_count"),
    )
