"""Consolidating pairwise matches into groups: hash-to-min over rows.

Every vertex v keeps a cluster set C(v), stored as rows (v, u), which starts as its neighbours and itself.
In each round v sends its whole set to the smallest member m of it and sends m to every member; the new sets
are what arrived, and v itself. In the end the smallest vertex of a component holds the component and every other vertex
holds itself and that smallest vertex. Now and then components that have come so far leave the rounds, so only deep ones
go on. A round is one job: the minimum of each set and the rows that its members are sent.

Sets are never gathered into one row: a hub's set is as many rows as it has members, so it spreads over tasks, the
minimum is taken with map-side combining, and the join back to the rows is one that adaptive execution may split where a
vertex is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filigraph.sources.files import numbered
from filigraph.tables import cut, drop_cut

#: Verdicts that say "merge" once letter case, blanks, quotes and marks are dropped.
MERGE_WORDS = ("merge", "merged", "tomerge", "domerge")


def says_merge(decision: Column) -> Column:
    """True where a verdict, noted in whatever way, says that the pair is to be merged; null is false."""
    return F.coalesce(F.regexp_replace(F.lower(decision), "[^a-z]", "").isin(*MERGE_WORDS), F.lit(False))


#: The rounds after which settled components leave; later on every third.
SETTLE = (1, 3)


def connected_groups(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(group_id, element_id) of every element that ``pairs`` links to another one; group_id is the smallest id.

    Null and blank ends and self pairs link nothing; repeated and turned pairs count once; an empty input gives no
    rows; other columns are ignored. Ids are compared as stored, byte by byte.
    """
    ends = pairs.select(F.col(a).alias("v"), F.col(b).alias("u"))
    ends = ends.filter(F.col("v").isNotNull() & F.col("u").isNotNull() & (F.col("v") != F.col("u")))
    if dict(ends.dtypes)["v"] == "string":
        ends = ends.filter((F.trim("v") != "") & (F.trim("u") != ""))
    if dict(ends.dtypes)["v"] != "string":
        return _rounds(ends, max_rounds)
    # numbers in the order of the ids: minima, joins and shuffles of the rounds are over 8 bytes each
    ids = cut(numbered(ends.select(F.explode(F.array("v", "u")).alias("id")).distinct(), ["id"], "n"))
    name = lambda old, new: ids.select(F.col("id").alias(new), F.col("n").alias(old))
    coded = ends.distinct().join(ids.select(F.col("id").alias("v"), F.col("n").alias("a")), "v").join(ids.select(F.col("id").alias("u"), F.col("n").alias("b")), "u").select(F.col("a").alias("v"), F.col("b").alias("u"))
    found = _rounds(coded, max_rounds).withColumnsRenamed({"group_id": "g", "element_id": "e"})
    return found.join(name("e", "element_id"), "e").join(name("g", "group_id"), "g").select("group_id", "element_id")


def _rounds(ends: DataFrame, max_rounds: int) -> DataFrame:
    """(group_id, element_id) of the edges ``ends`` (v, u), by rounds of hash-to-min."""
    row = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    every = ends.select(F.explode(F.array(row("v", "u"), row("u", "v"), row("v", "v"), row("u", "u"))).alias("e")).select("e.v", "e.u").distinct()
    state, rows = counted_cut(every)
    settled = []
    for n in range(max_rounds):
        if not rows:
            return reduce(DataFrame.union, settled) if settled else state.select(F.col("v").alias("group_id"), F.col("u").alias("element_id"))
        low = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("size"))
        if n in SETTLE or n > max(SETTLE) and n % 3 == 0:
            low = cut(low)
            # u is in C(m) exactly if m is in C(u); so a smallest vertex all of whose members know nothing but it is done
            leaves = low.filter("size = 2 and m <> v").groupBy(F.col("m").alias("v")).agg(F.count(F.lit(1)).alias("leaves"))
            done = low.filter("m = v").join(leaves, "v").filter("size - 1 = leaves").select(F.col("v").alias("m"))
            settled.append(low.join(done, "m").select(F.col("m").alias("group_id"), F.col("v").alias("element_id")))
            low = low.join(done, "m", "left_anti")
        # v itself is in C(v): it is sent to m, m is sent to it, and it stays
        stays = F.when(F.col("u") == F.col("v"), row("v", "v"))
        sent = state.join(low.select("v", "m"), "v").select(F.explode(F.array_compact(F.array(row("m", "u"), row("u", "m"), stays))).alias("e"))
        new, rows = counted_cut(sent.select("e.v", "e.u").distinct())
        drop_cut(state)
        state = new
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written and read back, and its number of rows, which the same job counts."""
    seen = Observation()
    read = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return read, seen.get["rows"]


def merge_groups(decisions: DataFrame) -> DataFrame:
    """Groups of the elements that rows of ``decisions`` say are to be merged; confidence plays no part."""
    return connected_groups(decisions.filter(says_merge(F.col("decision"))), "entity_a_element_id", "entity_b_element_id")
