"""A property graph as data frames: one per label, one per edge type, and generic views over all of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes``: label to frame with the key column first; ``edges``: type to frame with src, dst and properties."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def with_nodes(self, label: str, df: DataFrame) -> Graph:
        """The graph with ``df`` as the nodes of ``label``."""
        return replace(self, nodes={**self.nodes, label: df})

    def with_edges(self, kind: str, df: DataFrame) -> Graph:
        """The graph with ``df`` as the edges of type ``kind``."""
        return replace(self, edges={**self.edges, kind: df})

    def key(self, label: str) -> str:
        """The key column of a label: its first one."""
        return self.nodes[label].columns[0]

    def all_nodes(self) -> DataFrame:
        """(id, labels, props) of all nodes; null properties and vectors are left out."""

        def view(label: str, df: DataFrame) -> DataFrame:
            names = [c for c, kind in df.dtypes[1:] if not kind.startswith(("array", "map", "struct"))]
            pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in names)) if names else F.expr("cast(array() as array<struct<k:string,v:string>>)")
            return df.select(F.col(df.columns[0]).cast("string").alias("id"), F.array(F.lit(label)).alias("labels"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("props"))

        return reduce(DataFrame.unionByName, [view(label, df) for label, df in self.nodes.items()])

    def all_edges(self) -> DataFrame:
        """(src, dst, type) of all edges."""
        return reduce(DataFrame.unionByName, [df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(kind).alias("type")) for kind, df in self.edges.items()])

    def label_counts(self) -> DataFrame:
        """(label, nodes): one count per label, by union, so that nothing is counted under two labels at once."""
        return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(label).alias("label"), "nodes") for label, df in self.nodes.items()])

    def edge_counts(self) -> DataFrame:
        """(type, edges): one count per edge type."""
        return self.all_edges().groupBy("type").agg(F.count(F.lit(1)).alias("edges"))
