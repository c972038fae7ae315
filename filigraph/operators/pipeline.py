"""The pipeline around the graph: providers, embedding, extraction, resolution, cleansing plans, and comparisons.

External models sit behind :class:`Providers`: plain functions from columns or frames to columns or frames. The
defaults are deterministic and stay inside Spark; a network client would be a pandas UDF in their place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph import schema
from filigraph.functions import expressions as X
from filigraph.graph import Graph
from filigraph.operators import mutate, resolve, retrieve, text


@dataclass(frozen=True)
class Providers:
    """Embedder (text to vector), validator (name, value to keep), normaliser (text to text)."""

    embed: Callable[[Column], Column] = text.hashed_embedding
    keep: Callable[[Column, Column], Column] = lambda name, value: X.is_number_like(value)
    normalize: Callable[[Column], Column] = X.collapsed


@dataclass(frozen=True)
class ResolutionConfig:
    """Strategy (``fuzzy``, ``prefix`` or ``honorific``), threshold and largest group of a resolution run."""

    strategy: str = "fuzzy"
    threshold: float = 0.6
    max_group: int = 10
    extra: dict[str, str] = field(default_factory=dict)


#: Candidate strategies by name: (names, key, name, threshold) to (a, b, score).
STRATEGIES: dict[str, Callable[[DataFrame, str, str, float], DataFrame]] = {
    "fuzzy": resolve.fuzzy_pairs,
    "prefix": resolve.prefix_pairs,
    "honorific": resolve.honorific_stages,
}


def embed_missing(chunks: DataFrame, body: str, vector: str, providers: Providers | None = None) -> DataFrame:
    """``chunks`` with a vector where there was none; vectors that are there are not computed again."""
    embed = (providers or Providers()).embed
    return chunks.withColumn(vector, F.coalesce(F.col(vector), F.when(F.col(body).isNotNull(), embed(F.col(body)))))


def upsert_vectors(chunks: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``chunks`` with the vectors of ``vectors`` (key, vector) put in by key."""
    return mutate.set_field(chunks, vectors, key, vector)


def extracted(chunks: DataFrame, key: str, body: str, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """(label, src, dst): entities of each label's dictionary (id, name) that a chunk mentions in full."""
    out = None
    for label, names in dictionaries.items():
        found = text.mentions(chunks, key, body, names, "name", "id").select(F.lit(label).alias("label"), "src", "dst")
        out = found if out is None else out.unionByName(found)
    return out


def with_company(documents: DataFrame, metadata: DataFrame, file: str) -> DataFrame:
    """Documents with the metadata of their file: name in canonical form, ticker, CIK and CUSIP, null where unknown."""
    known = metadata.select("file", X.canonical_name(F.col("name"), X.FILER_NAMES).alias("company"), "ticker", "cik", "cusip")
    return documents.join(known, F.element_at(F.split(file, "/"), -1) == F.col("file"), "left").drop("file")


def _richness(entities: DataFrame) -> Column:
    """Rank of an entity as survivor, the least first: most filled properties, most relationships, smallest id."""
    filled = F.col("filled") if "filled" in entities.columns else resolve.truthy_count(F.col("properties")) if "properties" in entities.columns else F.lit(0)
    links = F.col("relationship_count") if "relationship_count" in entities.columns else F.lit(0)
    down = lambda c: -F.coalesce(c, F.lit(0)).cast("bigint")
    return F.struct(down(filled).alias("p"), down(links).alias("r"), F.col("element_id").alias("id"))


def resolve_entities(entities: DataFrame, config: ResolutionConfig | None = None, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(component, element_id, name, status, rank): groups of ``entities`` (element_id, name, ticker, cik), each of one component and status.

    Exact names are collapsed first, null counting as ``''``; the richest entity of each name goes into the candidates, the
    judge's verdicts confirm them, and components are gated by size and completeness. Pairs that groups still lack are put
    to the judge once more. Copies of a name are ready in any case: with their component if that is ready, else as a group
    of their own, and a component that is not ready has one entity per name. The least ``rank`` survives: by ``filled`` or
    ``properties``, then ``relationship_count``, where ``entities`` has them, then by id.
    """
    config = config or ResolutionConfig()
    rows = entities.select("element_id", F.coalesce("name", F.lit("")).alias("name"), "ticker", "cik", _richness(entities).alias("rank"))
    facts = rows.groupBy("name").agg(F.min("rank").getField("id").alias("id"), F.max("ticker").alias("ticker"), F.max("cik").alias("cik"), F.count(F.lit(1)).alias("copies"))
    decide = judge or (lambda pairs: resolve.verdicts(pairs, facts, "id"))
    pairs = STRATEGIES[config.strategy](facts.filter("name <> ''"), "id", "name", config.threshold)
    confirmed = decide(pairs.select("a", "b")).filter("same").select("a", "b")
    labels = resolve.component_labels(confirmed, "a", "b")
    groups = resolve.gated_groups(confirmed, labels, config.max_group)
    more = decide(resolve.missing_pairs(confirmed, labels, groups).select("a", "b")).filter("same").select("a", "b")
    groups = resolve.gated_groups(confirmed.unionByName(more), labels, config.max_group).select("component", "status")
    members = labels.join(groups, "component")
    kept = facts.select("id", "name", "copies").join(members, "id", "left")
    ready = kept.filter("status = 'ready' or copies > 1").select("name", F.when(F.col("status") == "ready", F.col("component")).otherwise(F.col("id")).alias("component"), F.lit("ready").alias("status"))
    out = ready.join(rows, "name").select("component", "element_id", "name", "status", "rank")
    waiting = members.filter("status <> 'ready'").join(rows, F.col("id") == F.col("element_id"))
    return out.unionByName(waiting.select("component", "element_id", "name", "status", "rank"))


def merge_map(groups: DataFrame) -> DataFrame:
    """(id, survivor) of the groups that are ready; the least ``rank`` survives, without ranks the smallest element id."""
    ready = groups.filter("status = 'ready'")
    rank = F.col("rank") if "rank" in groups.columns else F.struct(F.col("element_id").alias("id"))
    first = ready.groupBy("component").agg(F.min(rank).getField("id").alias("survivor"))
    return ready.join(first, "component").filter("element_id <> survivor").select(F.col("element_id").alias("id"), "survivor")


@dataclass(frozen=True)
class CleansePlan:
    """What a cleansing run would do: removals (id), merges (id, survivor) and new texts (id, column value)."""

    removals: DataFrame
    merges: DataFrame
    changes: DataFrame


def cleanse_plan(nodes: DataFrame, key: str, name: str, value: str, groups: DataFrame, providers: Providers | None = None) -> CleansePlan:
    """The plan for one label; nothing is changed until it is applied, so it can be written and reviewed."""
    providers = providers or Providers()
    removals = nodes.filter(~F.coalesce(providers.keep(F.col(name), F.col(value)), F.lit(True))).select(F.col(key).alias("id"))
    merges = merge_map(groups.join(removals.select(F.col("id").alias("element_id")), "element_id", "left_anti"))
    after = providers.normalize(F.col(value))
    changes = nodes.filter(F.col(value).isNotNull() & (F.trim(value) != "")).select(F.col(key).alias("id"), F.col(value).alias("before"), after.alias("after")).filter("before <> after")
    return CleansePlan(removals, merges, changes)


def apply_cleanse(graph: Graph, label: str, value: str, plan: CleansePlan) -> Graph:
    """The graph after removals, then merges, then new texts."""
    key = graph.key(label)
    out = mutate.detach_delete(graph, label, plan.removals)
    merges = mutate.final_survivors(plan.merges)
    out = out.with_nodes(label, mutate.fuse_nodes(out.nodes[label], key, merges, F.col(key)))
    for kind, edges in out.edges.items():
        known = schema.EDGES.get(kind)
        # ids of one label may be those of another too: only ends that the label may stand at are redirected
        ends = tuple(e for i, e in enumerate(("src", "dst")) if known is None or any(pair[i] == label for pair in known.ends))
        if ends:
            out = out.with_edges(kind, mutate.redirect_edges(edges, merges, ends))
    updates = plan.changes.select(F.col("id").alias(key), F.col("after").alias(value))
    return out.with_nodes(label, mutate.set_field(out.nodes[label], updates, key, value))


def run_summary(groups: DataFrame) -> DataFrame:
    """(status, groups, entities, largest) of a resolution run."""
    per = groups.groupBy("component", "status").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("status").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("entities"), F.max("n").alias("largest"))


def name_differences(a: DataFrame, b: DataFrame, name: str, body: str) -> DataFrame:
    """(name, where, length): names of two extractions in ``both``, ``only_a`` or ``only_b``, and how texts compare."""
    x = a.filter(F.col(name).isNotNull()).groupBy(name).agg(F.max(F.length(body)).alias("_x"), F.lit(1).alias("_a"))
    y = b.filter(F.col(name).isNotNull()).groupBy(name).agg(F.max(F.length(body)).alias("_y"), F.lit(1).alias("_b"))
    where = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    longer = F.coalesce("_y", F.lit(0)) - F.coalesce("_x", F.lit(0))
    length = F.when(longer > 0, "longer").when(longer < 0, "shorter").otherwise("same")
    return x.join(y, name, "full_outer").select(name, where.alias("where"), F.when(where == "both", length).alias("length"))


def run_counters(entities: int, candidates: DataFrame, decisions: DataFrame, groups: DataFrame, merges: DataFrame) -> DataFrame:
    """One row of counters of a resolution run.

    ``candidates`` (a, b, score), ``decisions`` (decision, confidence; a null decision was never evaluated), ``groups`` (component,
    status, ...) and ``merges`` (id, survivor).
    """
    c = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg("score"), 6).alias("mean_score"))
    said = lambda x: F.count_if(F.col("decision") == x)
    d = decisions.agg(
        said("merge").alias("merge_decisions"), said("no_merge").alias("no_merge_decisions"), F.count_if(F.col("decision").isNull()).alias("unevaluated"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )
    per = groups.groupBy("component", "status").agg(F.count(F.lit(1)).alias("n"))
    state = lambda x: F.count_if(F.col("status") == x)
    g = per.agg(F.count(F.lit(1)).alias("groups"), state("ready").alias("ready"), state("needs_confirmation").alias("needs_confirmation"), state("flagged").alias("flagged"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    m = merges.agg(F.count(F.lit(1)).alias("merged"), F.count_distinct("survivor").alias("survivors"))
    out = c.crossJoin(d).crossJoin(g).crossJoin(m)  # one row each
    return out.select(F.lit(entities).cast("bigint").alias("entities"), "*", (F.lit(entities) - F.col("merged")).alias("remaining"))


def compared_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with an overall score, best first: more ground truth met, then more expected merges, then the older run.

    ``runs`` has expected_met, expected, forbidden_met, forbidden (counts of ground-truth checks) and created_at. The list of runs
    is short, so it is sorted as a whole.
    """
    overall = F.try_divide(F.col("expected_met") + F.col("forbidden_met"), F.col("expected") + F.col("forbidden"))
    return runs.withColumn("overall", F.round(overall, 6)).orderBy(F.desc_nulls_last("overall"), F.desc("expected_met"), "created_at")


def triple_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, type, dst, where): triples of two extractions in ``both``, ``only_a`` or ``only_b``."""
    key = ["src", "type", "dst"]
    x, y = (df.select(*key).distinct().withColumn(flag, F.lit(1)) for df, flag in ((a, "_a"), (b, "_b")))
    where = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return x.join(y, key, "full_outer").select(*key, where.alias("where"))


def missing_names(nodes: DataFrame, name: str, expected: list[str]) -> DataFrame:
    """(name) of the expected names that no node has."""
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in expected], f"{name} string")
    return wanted.join(nodes.select(name), name, "left_anti")


def count_differences(found: DataFrame, expected: DataFrame, key: str, n: str) -> DataFrame:
    """(key, found, expected) where the counts of two frames differ, absent ones counting as zero."""
    both = found.select(key, F.col(n).alias("found")).join(expected.select(key, F.col(n).alias("expected")), key, "full_outer")
    return both.fillna(0, ["found", "expected"]).filter("found <> expected")


def search(chunks: DataFrame, key: str, body: str, vector: str, question: str, k: int, enrich: Callable[[DataFrame], DataFrame] | None = None, providers: Providers | None = None) -> DataFrame:
    """The k chunks nearest to a question, enriched by a graph traversal of the caller; no text is generated."""
    embed = (providers or Providers()).embed
    query = chunks.sparkSession.createDataFrame([(question,)], "question string").select(embed(F.col("question")).alias("q"))
    hits = retrieve.vector_topk(chunks, key, vector, query, k).join(chunks.select(key, body), key)
    return enrich(hits) if enrich else hits


class NotReadOnly(ValueError):
    """The statement would do more than read."""


#: What a query may be made of, by the names of Spark's parsed plan nodes.
READING = frozenset(
    "Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith Union Intersect Except Generate "
    "WithWindowDefinition UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedHint Pivot Unpivot Sample UnresolvedOrderBy UnresolvedTableValuedFunction".split()
)
#: Table functions that only make rows, functions that call whatever class is named, and relations that are files.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
CALLING = frozenset("java_method reflect try_reflect".split())
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery".split())
FILES = frozenset("parquet csv json text orc avro xml binaryfile jdbc delta".split())


def _items(sequence: Any) -> list[Any]:
    return [sequence.apply(i) for i in range(sequence.size())]


def safe_sql(spark: SparkSession, statement: str, **arguments: object) -> DataFrame:
    """Run a statement that consists of nothing but the parts of a query; anything else is refused before it runs.

    The parts are those of :data:`READING`, in subqueries and named queries too. Scripts, commands, statements made at run
    time, functions that call classes by name and files in place of tables are refused.
    """
    try:
        walk = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    except Exception as error:
        raise NotReadOnly(f"not a query: {str(error).splitlines()[0]}") from error
    while walk:
        node = walk.pop()
        kind = node.getClass().getSimpleName()
        if kind not in READING:
            raise NotReadOnly(f"not a part of a query: {kind}")
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1 and node.multipartIdentifier().apply(0).lower() in FILES:
            raise NotReadOnly("files are no tables here")
        if kind == "UnresolvedTableValuedFunction" and node.name().mkString(".").lower() not in TABLE_FUNCTIONS:
            raise NotReadOnly(f"not a table function of queries: {node.name().mkString('.')}")
        if kind == "UnresolvedWith":
            walk += [pair._2() for pair in _items(node.cteRelations())]
        walk += _items(node.children())
        inner = _items(node.expressions())
        while inner:
            part = inner.pop()
            name = part.getClass().getSimpleName()
            if name == "UnresolvedFunction" and part.nameParts().mkString(".").lower().split(".")[-1] in CALLING:
                raise NotReadOnly(f"calls a class by name: {part.nameParts().mkString('.')}")
            if name in SUBQUERIES:
                walk.append(part.plan())
            inner += _items(part.children())
    return spark.sql(statement, args=arguments or None)


def schema_summary(graph: Graph) -> DataFrame:
    """(kind, name, column, type) of all labels and edge types."""
    rows = [(kind, name, c, t) for kind, frames in (("node", graph.nodes), ("edge", graph.edges)) for name, df in frames.items() for c, t in df.dtypes]
    spark = next(iter(graph.nodes.values())).sparkSession
    return spark.createDataFrame(rows, "kind string, name string, column string, type string")


#: Parameterised look-ups over the tables ``companies``, ``products``, ``metrics``, ``risks``, ``owns`` and ``documents``.
TEMPLATES = {
    "company_details": "select companyid, name, ticker, cik, cusip from companies where name = :name",
    "company_products": "select p.name from products p join companies c on c.companyid = p.companyid where c.name = :name",
    "company_metrics": "select m.name, m.value, m.period from metrics m join companies c on c.companyid = m.companyid where c.name = :name",
    "company_risks": "select distinct r.name, r.description from risks r join companies c on c.name = r.company where c.name = :name",
    "companies_of_manager": "select distinct c.name, c.ticker from owns o join companies c on c.companyid = o.dst where o.src = :id",
    "shared_risks": "select distinct a.name from risks a join risks b on b.name = a.name where a.company = :name and b.company = :other",
    "documents_by_company": "select distinct d.documentid from documents d join companies c on c.companyid = d.companyid where c.companyid = :id or c.ticker = :id or c.cik = :id",
}


def lookup(spark: SparkSession, template: str, tables: dict[str, DataFrame], **arguments: str) -> DataFrame:
    """Run one of :data:`TEMPLATES` over the given tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return safe_sql(spark, TEMPLATES[template], **arguments)
