"""Readers and writers: CSV, JSON lines, nested JSON, texts, backups, and exports with surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigraph.functions.expressions import surrogate
from filigraph.graph import Graph
from filigraph.operators.mutate import last_per_key
from filigraph.tables import cut


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and doubled quotes; columns by the given schema, leading zeros kept, junk in numbers fails."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', mode="FAILFAST", emptyValue="").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_filing(spark: SparkSession, path: str) -> DataFrame:
    """Nested filing documents: company, document, products, risk factors and the text."""
    item = "array<struct<name:string,description:string>>"
    schema = f"company struct<name:string,ticker:string,cik:string>, document struct<name:string,source:string>, products {item}, risk_factors {item}, filing_text string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, size): whole text files, trimmed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.col("value"), F.lit(" \t\r\n")).alias("text"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "text", F.length("text").alias("size"))


def company_metadata(rows: DataFrame, path: str, order: Column) -> DataFrame:
    """One row per file name, the last part of ``path``; rows without one are dropped, the last one in ``order`` wins."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    named = rows.withColumn("file", name).filter("file <> ''")
    return last_per_key(named, ["file"], order)


def latest_path(spark: SparkSession, folder: str, prefix: str, below: str | None = None) -> str | None:
    """The greatest path in ``folder`` whose name begins with ``prefix`` (and comes before ``below``); time stamps in names sort by time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(s.getPath()) for s in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)]
    named = [p for p in found if (name := p.rsplit("/", 1)[-1]).startswith(prefix) and (below is None or name < below)]
    return max(named, default=None)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV part files with a header and the columns in the given order."""
    df.select(*columns).write.options(header=True, quote='"', escape='"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines; arrays stay arrays, nulls are left out."""
    df.write.json(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers 0, 1, 2, ... in ``order``, without gathering the rows in one task.

    Rows are range-partitioned and sorted, numbered within partitions, and shifted by the sizes of those before.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # one row per slice
    shifted = placed.join(F.broadcast(sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))), "_slice")
    n = F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    return shifted.withColumn(name, n).drop("_slice", "_before")


def with_surrogate_ids(df: DataFrame, order: list[str], prefix: str, name: str = "surrogate_id") -> DataFrame:
    """``df`` with ids ``C001``, ``C002``, ... in ``order``; see :func:`numbered`."""
    return numbered(df, order, "_at").withColumn(name, surrogate(prefix, F.col("_at") + 1)).drop("_at")


def backup(graph: Graph, path: str) -> DataFrame:
    """Write nodes and edges as Parquet and return the manifest (kind, name, rows), which is written beside them."""
    for label, df in graph.nodes.items():
        df.write.parquet(f"{path}/nodes/{label}")
    for kind, df in graph.edges.items():
        df.write.parquet(f"{path}/edges/{kind}")
    nodes = graph.label_counts().select(F.lit("nodes").alias("kind"), F.col("label").alias("name"), F.col("nodes").alias("rows"))
    manifest = nodes.unionByName(graph.edge_counts().select(F.lit("edges").alias("kind"), F.col("type").alias("name"), F.col("edges").alias("rows")))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> Graph:
    """The graph of a backup; it is checked against the manifest before anything is handed out."""
    manifest = spark.read.parquet(f"{path}/manifest").collect()  # one row per label and edge type
    names = {kind: [r["name"] for r in manifest if r["kind"] == kind] for kind in ("nodes", "edges")}
    if not any(r["rows"] for r in manifest if r["kind"] == "nodes"):
        raise ValueError("the backup has no nodes")
    graph = Graph({n: spark.read.parquet(f"{path}/nodes/{n}") for n in names["nodes"]}, {n: spark.read.parquet(f"{path}/edges/{n}") for n in names["edges"]})
    for r in manifest:
        found = (graph.nodes if r["kind"] == "nodes" else graph.edges)[r["name"]].count()
        if found != r["rows"]:
            raise ValueError(f"{r['kind']} {r['name']}: {found} rows, {r['rows']} in the manifest")
    return graph
