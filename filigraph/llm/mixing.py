"""Mixing sources to target weights: systematic sampling over prefix sums of expected copies.

Within a source every document is expected to be used equally often, r = wanted tokens / tokens of the source. The
documents are ordered by size, the expected copies are prefix-summed, one random offset is added, and a document is
emitted once per whole number that its sum crosses; so it is used either floor(r) or ceil(r) times, and all sizes are
met in proportion. The prefix sums are distributed: rows are range-partitioned, numbered within a partition, and
shifted by the counts of the partitions before it; a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.tables import cut


def wanted_sizes(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, have, wanted, copies): what each source has and is to give.

    Without ``total_tokens`` the total is the largest for which every source that has documents can reach its share;
    with it, a source gives as much of its share as ``max_repeats`` permits. Sources without documents give nothing.
    """
    aims = targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    have = sized.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint")).alias("have"))
    rows = aims.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    limit = F.min(F.when(F.col("have") > 0, F.col("have") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # one row per source
    total = F.lit(float(total_tokens)) if total_tokens else limit
    rows = rows.withColumn("wanted", F.least(total * F.col("target_share"), F.col("have") * F.col("max_repeats")))
    rows = rows.withColumn("copies", F.when(F.col("have") > 0, F.least(F.col("wanted") / F.col("have"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    return rows.select("source", "target_share", "max_repeats", "have", "wanted", "copies")


def _offset(seed: int) -> Column:
    """One number in [0, 1) per source, fixed by the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_003)) / F.lit(1_000_003.0)


def mixed(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copy): the selection; a document used n times has copies 1 to n.

    Documents whose source is null or has no target are not selected; an empty input gives an empty selection.
    """
    sized = cut(sized.select("doc_id", "source", "tokens"))
    wanted = cut(wanted_sizes(sized, targets, total_tokens))
    rows = sized.join(F.broadcast(wanted.select("source", "copies")), "source")  # one row per target
    order = ["tokens", "mark", "doc_id"]
    rows = rows.withColumn("mark", F.xxhash64(F.lit(seed), "doc_id")).repartitionByRange("source", *order)
    placed = cut(rows.withColumn("slice", F.spark_partition_id()))
    counts = placed.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))  # one row per slice
    ranked = placed.join(F.broadcast(counts.select("source", "slice", F.coalesce(before, F.lit(0)).alias("before"))), ["source", "slice"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "slice").orderBy(*order))
    ranked = ranked.withColumn("rank", rank)
    crossed = (F.floor(_offset(seed) + F.col("rank") * F.col("copies")) - F.floor(_offset(seed) + (F.col("rank") - 1) * F.col("copies"))).cast("int")
    return ranked.withColumn("n", crossed).filter("n > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, rows, most_repeats) of a selection, one row per target."""
    per = selection.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint")).alias("tokens"), F.count(F.lit(1)).alias("rows"), F.max("copy").alias("most_repeats"))
    rows = targets.select("source", "target_share").join(per, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
