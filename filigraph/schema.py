"""The registry of the graph: labels with their keys and columns, edge types with their ends, artifact schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def struct(**columns: T.DataType) -> T.StructType:
    """A schema of nullable columns."""
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


@dataclass(frozen=True)
class Label:
    """A node label: its key column and its columns."""

    key: str
    schema: T.StructType
    unique: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edge:
    """An edge type: the labels it may join and the properties it carries."""

    ends: tuple[tuple[str, str], ...]
    properties: T.StructType = field(default_factory=T.StructType)


#: The labels and edge types of the filings graph.
LABELS = {
    "Company": Label("companyId", struct(companyId=S, name=S, ticker=S, cik=S, cusip=S), ("name",)),
    "Product": Label("productId", struct(productId=S, name=S, description=S)),
    "RiskFactor": Label("riskId", struct(riskId=S, name=S, description=S)),
    "FinancialMetric": Label("metricId", struct(metricId=S, name=S, value=S, period=S)),
    "AssetManager": Label("managerId", struct(managerId=S, name=S)),
    "Executive": Label("executiveId", struct(executiveId=S, name=S, title=S)),
    "Document": Label("documentId", struct(documentId=S, accessionNumber=S, filingType=S, source=S, name=S, path=S, cik=S)),
    "Chunk": Label("chunkId", struct(chunkId=S, index=L, text=S, embedding=T.ArrayType(T.FloatType()))),
}
EDGES = {
    "OFFERS": Edge((("Company", "Product"),)),
    "FACES_RISK": Edge((("Company", "RiskFactor"),)),
    "REPORTS": Edge((("Company", "FinancialMetric"),)),
    "HAS_EXECUTIVE": Edge((("Company", "Executive"),)),
    "OWNS": Edge((("AssetManager", "Company"),), struct(shares=L)),
    "COMPETES_WITH": Edge((("Company", "Company"),)),
    "PARTNERS_WITH": Edge((("Company", "Company"),)),
    "FILED": Edge((("Company", "Document"),)),
    "FROM_DOCUMENT": Edge((("Chunk", "Document"),)),
    "NEXT_CHUNK": Edge((("Chunk", "Chunk"),)),
    "FROM_CHUNK": Edge((("Company", "Chunk"), ("Product", "Chunk"), ("RiskFactor", "Chunk"), ("FinancialMetric", "Chunk"))),
}
SNAPSHOT_ENTITY = struct(element_id=S, name=S, labels=T.ArrayType(S), properties=T.MapType(S, S), source_chunks=T.ArrayType(S), relationship_count=L)
MERGE_DECISION = struct(entity_a_name=S, entity_a_element_id=S, entity_b_name=S, entity_b_element_id=S, decision=S, confidence=T.DoubleType(), reasoning=S)
REMOVAL_DECISION = struct(entity_type=S, element_id=S, name=S, company=S, reasoning=S)
