"""Changes of a graph as functions from frames to frames: upserts, deletes, fusion, and links by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph.graph import Graph
from filigraph.tables import cut, drop_cut


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the one that comes last in ``order``; nothing is sorted, a maximum is taken."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_nodes(nodes: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Upsert by key: a key that is there gets the columns of ``rows`` (nulls too), a new one is added.

    Columns that only one side has keep, or start as, null. Repeated keys in ``rows``: the last in ``order`` wins.
    Rows with a null key are not merged.
    """
    new = last_per_key(rows.filter(F.col(key).isNotNull()), [key], order)
    set_ = [c for c in new.columns if c != key]
    kept = [c for c in nodes.columns if c not in new.columns]
    new = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in set_), F.lit(True).alias("_hit"))
    both = nodes.join(new, key, "full_outer")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in nodes.columns else F.col(f"_new_{c}").alias(c)
    return both.select(key, *(value(c) for c in set_), *kept)


def merge_stubs(nodes: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """``nodes`` with one stub, all else null, for every name that no node has yet."""
    fresh = names.select(key).filter(F.col(key).isNotNull()).distinct().join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True)


def merge_edges(rows: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str, with_properties: bool = False) -> DataFrame:
    """Edges of ``rows`` (src, dst, properties) whose ends both exist, once each; properties belong to the key on demand."""
    found = rows.join(sources.select(F.col(source_key).alias("src")), "src", "left_semi").join(targets.select(F.col(target_key).alias("dst")), "dst", "left_semi")
    return found.distinct() if with_properties else found.dropDuplicates(["src", "dst"])


def merge_edges_last(rows: DataFrame, order: Column) -> DataFrame:
    """One edge per (src, dst), its properties from the row that comes last in ``order``."""
    return last_per_key(rows, ["src", "dst"], order)


def set_field(nodes: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``nodes`` with ``column`` replaced where ``updates`` (key, column) has the key, also by null."""
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    both = nodes.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
    return both.select(*nodes.columns)


def add_labels(labels: Column, more: Column) -> Column:
    """Labels with others appended, each once, the first ones first."""
    return F.array_union(labels, more)


def detach_delete(graph: Graph, label: str, ids: DataFrame) -> Graph:
    """The graph without the nodes ``ids`` of ``label`` and without every edge at them."""
    key = graph.key(label)
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    out = graph.with_nodes(label, graph.nodes[label].join(gone, F.col(key) == F.col("_gone"), "left_anti"))
    for kind, edges in graph.edges.items():
        kept = edges.join(gone, F.col("src") == F.col("_gone"), "left_anti")
        out = out.with_edges(kind, kept.join(gone, F.col("dst") == F.col("_gone"), "left_anti"))
    return out


def without_blank_keys(graph: Graph, label: str, column: str) -> Graph:
    """The graph without the nodes of ``label`` whose ``column`` is the empty string; null stays."""
    blank = graph.nodes[label].filter(F.col(column) == "").select(graph.key(label))
    return detach_delete(graph, label, blank)


def final_survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor) with chains followed to their end, by pointer doubling; ``merges`` maps each id to a survivor.

    Of several survivors of one id the smallest counts. Merges in a circle leave its smallest id, which is not in the result.
    """
    state = cut(merges.select("id", "survivor").filter("id <> survivor").groupBy("id").agg(F.min("survivor").alias("survivor")).withColumn("low", F.least("id", "survivor")))
    # after so many doublings every chain has ended, and whoever still points on points into a circle
    for _ in range(int(state.count()).bit_length() + 1):
        after = state.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"), F.col("low").alias("below"))
        step = state.join(after, "survivor", "left")
        new = cut(step.select("id", F.coalesce("next", "survivor").alias("survivor"), F.least("low", F.coalesce("below", "low")).alias("low"), F.col("next").isNotNull().alias("moved")))
        moved = not new.filter("moved").isEmpty()
        drop_cut(state)
        state = new.drop("moved")
        state._filigraph_path = new._filigraph_path
        if not moved:
            return state.select("id", "survivor")
    circle = state.select(F.col("id").alias("survivor"), F.col("low").alias("least"))
    return state.join(circle, "survivor", "left").select("id", F.coalesce("least", "survivor").alias("survivor")).filter("id <> survivor")


def fuse_nodes(nodes: DataFrame, key: str, merges: DataFrame, order: Column) -> DataFrame:
    """``nodes`` with the consumed ones gone and the gaps of their survivors filled.

    ``merges`` is (id, survivor). A survivor keeps what it has; a column that is null or ``''`` takes the first value,
    in ``order`` of the consumed rows, that is neither.
    """
    rest = [c for c in nodes.columns if c != key]
    said = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    consumed = nodes.join(merges.select(F.col("id").alias(key), "survivor"), key)
    offers = consumed.groupBy("survivor").agg(*(F.min_by(said(c), F.when(said(c).isNotNull(), order)).alias(f"_o_{c}") for c in rest))
    kept = nodes.join(merges.select(F.col("id").alias(key)), key, "left_anti").join(offers, F.col(key) == F.col("survivor"), "left")
    return kept.select(key, *(F.coalesce(said(c), F.col(f"_o_{c}"), F.col(c)).alias(c) for c in rest))


def redirect_edges(edges: DataFrame, merges: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """``edges`` with consumed ``ends`` replaced by survivors, all properties kept; loops that arise stay.

    Edges that do not move stay as they are. Of moved ones that become parallel one stays: that of the smallest old ends;
    none stays where an edge that did not move joins the same nodes.
    """
    moved = edges
    for e in ("src", "dst"):
        moved = moved.join(merges.select(F.col("id").alias(e), F.col("survivor").alias(f"_{e}")), e, "left") if e in ends else moved.withColumn(f"_{e}", F.lit(None).cast(dict(edges.dtypes)[e]))
    still = moved.filter("_src is null and _dst is null").select(*edges.columns)
    gone = moved.filter("_src is not null or _dst is not null")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    turned = gone.groupBy(F.coalesce("_src", "src").alias("_s"), F.coalesce("_dst", "dst").alias("_d")).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_")), F.struct("src", "dst")).alias("_r"))
    turned = turned.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *(F.col("_r")[c].alias(c) for c in rest))
    return still.unionByName(turned.join(still.select("src", "dst"), ["src", "dst"], "left_anti"))


def combine_by_name(nodes: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row per name; of each column the sorted distinct values, joined by `` | `` where they conflict, null if none."""
    sets = nodes.filter(F.col(name).isNotNull()).groupBy(name).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))
    return sets.withColumns({c: F.when(F.size(c) > 0, F.array_join(c, " | ")) for c in columns})


def key_violations(nodes: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that more than one node has; a uniqueness constraint holds if there is none."""
    return nodes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def filed_links(companies: DataFrame, documents: DataFrame) -> DataFrame:
    """(companyId, documentId, how): documents linked to companies by name, then by CIK where the name linked nothing."""
    by_name = documents.filter("name is not null").join(companies.select("companyId", "name"), "name").select("companyId", "documentId", F.lit("name").alias("how"))
    by_cik = documents.filter("cik is not null").join(companies.select("companyId", "cik"), "cik").select("companyId", "documentId", F.lit("cik").alias("how"))
    return by_name.unionByName(by_cik.join(by_name, ["companyId", "documentId"], "left_anti")).distinct()


def provenance_links(from_chunk: DataFrame, from_document: DataFrame, filed: DataFrame, existing: DataFrame) -> DataFrame:
    """Company-to-entity edges: ``existing`` and those that an entity's chunk, its document and the filer imply."""
    chunk = from_document.select(F.col("src").alias("chunk"), F.col("dst").alias("document"))
    owner = filed.select(F.col("src").alias("company"), F.col("dst").alias("document"))
    implied = from_chunk.select(F.col("src").alias("entity"), F.col("dst").alias("chunk")).join(chunk, "chunk").join(owner, "document")
    return existing.select("src", "dst").unionByName(implied.select(F.col("company").alias("src"), F.col("entity").alias("dst"))).distinct()


def create_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` and ``more`` without looking for what is there already: duplicates stay."""
    return rows.unionByName(more, allowMissingColumns=True)


def add_properties(properties: Column, more: dict[str, Column]) -> Column:
    """A property map with ``more`` put over it; keys that are not listed stay, a null value takes its key away."""
    new = F.map_filter(F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*more))
    return F.map_concat(kept, new)


def merge_and_label(nodes: DataFrame, rows: DataFrame, key: str, labels: str, order: Column) -> DataFrame:
    """Upsert by key with the labels of ``rows`` appended: a node keeps its labels, and the last row's properties win."""
    said = rows.filter(F.col(key).isNotNull()).select(F.col(key), F.explode(labels).alias("_l")).groupBy(key).agg(F.array_sort(F.collect_set("_l")).alias("_new"))
    merged = merge_nodes(nodes, rows.drop(labels), key, order).join(said, key, "left")
    none = F.array().cast("array<string>")
    return merged.withColumn(labels, F.array_union(F.coalesce(labels, none), F.coalesce("_new", none))).drop("_new")


def listed_merges(nodes: DataFrame, key: str, name: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(id, survivor) of a fixed list of (consumed name, surviving name); pairs of which one is missing are skipped.

    Of several nodes of a name the smallest key stands for it.
    """
    spark = nodes.sparkSession
    wanted = spark.createDataFrame(pairs, "gone string, stays string")
    first = nodes.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_n")).agg(F.min(key).alias("_k"))
    found = F.broadcast(wanted).join(first.toDF("gone", "id"), "gone").join(first.toDF("stays", "survivor"), "stays")
    return found.filter("id <> survivor").select("id", "survivor").distinct()


def rivals_by_mention(mentioned: DataFrame, filers: DataFrame) -> DataFrame:
    """(src, dst): a company and every other one that is named in a chunk which it filed, once each.

    ``mentioned`` is (src company, dst chunk), ``filers`` (chunk, company).
    """
    both = mentioned.select(F.col("src").alias("other"), F.col("dst").alias("chunk")).join(filers, "chunk")
    return both.filter(F.col("company") != F.col("other")).select(F.col("company").alias("src"), F.col("other").alias("dst")).distinct()
