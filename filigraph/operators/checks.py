"""Quality checks: each is a frame of findings or figures; a check without findings has no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigraph.graph import Graph
from filigraph.schema import EDGES


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, filled): how many rows have each column neither null nor ``''``, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False))).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns))
    return sums.select("rows", F.explode(pairs).alias("p")).select("p.column", "rows", "p.filled")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): combinations that several rows have; nulls count as equal."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wrong_ends(graph: Graph) -> DataFrame:
    """(type, src_label, dst_label, edges): edges whose ends have labels that the schema does not allow, or none."""
    labels = graph.all_nodes().select("id", F.col("labels")[0].alias("label")).distinct()
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label")), labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    allowed = F.lit(False)
    for kind, edge in EDGES.items():
        for x, y in edge.ends:
            allowed = allowed | ((F.col("type") == kind) & (F.col("src_label") == x) & (F.col("dst_label") == y))
    ends = graph.all_edges().join(a, "src", "left").join(b, "dst", "left")
    return ends.filter(~F.coalesce(allowed, F.lit(False))).groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("edges"))


def orphans(graph: Graph) -> DataFrame:
    """(label, nodes, orphans): nodes per label and how many of them no edge touches."""
    touched = graph.all_edges().select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("hit", F.lit(1))
    nodes = graph.all_nodes().select("id", F.col("labels")[0].alias("label"))
    return nodes.join(touched, "id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("hit").isNull()).alias("orphans"))


def chunk_gaps(chunks: DataFrame, document: str, index: str) -> DataFrame:
    """(document, chunks, first, last): documents whose chunk indexes are not 0 to n - 1, once each."""
    per = chunks.groupBy(document).agg(F.count(F.lit(1)).alias("chunks"), F.min(index).alias("first"), F.max(index).alias("last"), F.count_distinct(index).alias("kinds"))
    return per.filter("first <> 0 or last <> chunks - 1 or kinds <> chunks").drop("kinds")


def round_trip_differences(before: DataFrame, after: DataFrame, key: str, text: str, vector: str, tolerance: float = 1e-10) -> DataFrame:
    """(key, problem): rows that a write and a read lost, added, or changed in text or vector."""
    a = before.select(key, F.col(text).alias("_t"), F.col(vector).alias("_v"), F.lit(True).alias("_a"))
    b = after.select(key, F.col(text).alias("_u"), F.col(vector).alias("_w"), F.lit(True).alias("_b"))
    far = F.exists(F.zip_with("_v", "_w", lambda x, y: F.coalesce(F.abs(x - y) > tolerance, F.lit(True))), lambda x: x)
    problem = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "lost").when(~F.col("_t").eqNullSafe(F.col("_u")), "text").when(F.col("_v").isNull() != F.col("_w").isNull(), "vector").when(far, "vector")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def dimension_counts(df: DataFrame, vector: str) -> DataFrame:
    """(dimensions, rows): how many vectors have each length; null vectors count as -1."""
    return df.groupBy(F.coalesce(F.size(vector), F.lit(-1)).alias("dimensions")).agg(F.count(F.lit(1)).alias("rows"))


def merge_checks(nodes: DataFrame, name: str, unique: list[str], separate: list[tuple[str, str]]) -> DataFrame:
    """(kind, name, other, status): names that one node must have, and pairs of names that must stay apart.

    ``PASS`` or ``FAIL``; ``SKIP`` where no node has the name, or where one name of a pair is missing.
    """
    spark = nodes.sparkSession
    held = nodes.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in unique], "name string"))  # a fixed list
    once = wanted.join(held, "name", "left").select(F.lit("unique").alias("kind"), "name", F.lit(None).cast("string").alias("other"), F.when(F.col("n").isNull(), "SKIP").when(F.col("n") == 1, "PASS").otherwise("FAIL").alias("status"))
    pairs = F.broadcast(spark.createDataFrame(separate, "name string, other string"))
    both = pairs.join(held, "name", "left").join(held.select(F.col("name").alias("other"), F.col("n").alias("m")), "other", "left")
    apart = both.select(F.lit("separate").alias("kind"), "name", "other", F.when(F.col("n").isNull() | F.col("m").isNull(), "SKIP").when(F.col("name") != F.col("other"), "PASS").otherwise("FAIL").alias("status"))
    return once.unionByName(apart)


def search_checks(results: dict[str, DataFrame], answer: str) -> DataFrame:
    """(retriever, hits, answered, status) of several retrievers: ``PASS`` with a hit and an answer (column ``answer``) that is not blank."""
    found = [df.agg(F.lit(n).alias("retriever"), F.count(F.lit(1)).alias("hits"), F.count_if(F.coalesce(F.trim(F.col(answer)) != "", F.lit(False))).alias("answered")) for n, df in results.items()]
    return reduce(DataFrame.unionByName, found).withColumn("status", F.when((F.col("hits") > 0) & (F.col("answered") > 0), "PASS").otherwise("FAIL"))
