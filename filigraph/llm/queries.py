"""The queries of the numbered problems that belong to training-data pipelines, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.llm import canonical, components, mixing, neighbours, packing, residue, survivors, tokens, variants
from filigraph.tables import cut, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 2: the listed company that each free entry means, or UNMATCHED."""
    return canonical.matched_companies(table(spark, folder, "company_competitors"), table(spark, folder, "companies"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 3: the group of every element that a verdict links to another one."""
    return components.merge_groups(table(spark, folder, "merge_decisions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 4: every two spellings of one company or person."""
    spelt = variants.filed_names(table(spark, folder, "asset_manager_holdings"), table(spark, folder, "company_competitors"), table(spark, folder, "snapshot_entities"))
    return variants.variant_pairs(spelt, table(spark, folder, "companies").select(F.col("ticker").alias("symbol"), "name"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 5: pairs of chunks of which one is among the five nearest of the other."""
    return neighbours.nearest_pairs(table(spark, folder, "nova_embeddings"), "chunkid", "embedding")


def p6_fused(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 6: survivor, donors by rank and by fusion, and fused value of every field of every duplicate group."""
    return survivors.fused_values(table(spark, folder, "snapshot_entities"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 6: survivor and donors of every duplicate group by rank, on which the fusion has no say."""
    return survivors.group_survivors(table(spark, folder, "snapshot_entities")).select("survivor_id", "prop", "donor_id")


def p6_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 6: fields that fusion and a plain majority get right with copiers planted over the whole table."""
    return survivors.planted_accuracy(table(spark, folder, "snapshot_entities"))


#: Sources that one container may not mix.
APART = (("call_notes", "press"), ("press", "proxy"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 8: every document, or piece of one, in a container of each size."""
    sized = cut(tokens.sized_documents(table(spark, folder, "documents")))
    return packing.packed(sized, table(spark, folder, "container_sizes"), APART)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 8: how full the containers of each size are."""
    return packing.fill_rates(p8_packed(spark, folder), table(spark, folder, "container_sizes"))


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 9: a selection in which the sources have their target shares."""
    return mixing.mixed(tokens.sized_documents(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 9: the shares that the selection reaches."""
    return mixing.reached_shares(p9_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 10: documents that are, or contain, template residue, filler or notices."""
    return residue.residue_documents(table(spark, folder, "documents"))


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 10: the documents without residue, counted by source and language."""
    kept = residue.without_residue(table(spark, folder, "documents"))
    return kept.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


_P3 = """with recursive m as (select entity_a_element_id a, entity_b_element_id b from merge_decisions where regexp_replace(lower(decision), '[^a-z]', '', 'g') in ('merge', 'merged', 'tomerge', 'domerge')),
e as (select a, b from m where a <> b and trim(a) <> '' and trim(b) <> '' union select b, a from m where a <> b and trim(a) <> '' and trim(b) <> ''),
reach(id, other) as (select a, b from e union select r.id, e.b from reach r join e on e.a = r.other)
select least(id, min(other)) group_id, id element_id from reach group by id"""
_STAND_INS = ", ".join(f"'{x}'" for x in survivors.STAND_INS)
_P6 = f"""with last as (select element_id, arg_max({{'label': label, 'name': name, 'p': properties, 'c': source_chunks, 'n': relationship_count}}, exported_at) r from snapshot_entities where element_id is not null group by 1),
f as (select element_id, r.label, r.name, r.n rel, coalesce(len(list_distinct(list_filter(r.c, lambda x: x is not null))), 0) chunks,
list_filter(map_entries(r.p), lambda x: not starts_with(x.key, '__') and x.value is not null and regexp_matches(x.value, '[\\p{{L}}\\p{{N}}]') and lower(trim(x.value)) not in ({_STAND_INS})) props from last where trim(r.name) <> ''),
k as (select *, row_number() over (partition by label, name order by coalesce(len(props), 0) desc, rel desc nulls last, chunks desc, element_id) rn, count(*) over (partition by label, name) n from f),
s as (select label, name, element_id survivor from k where rn = 1 and n > 1), v as (select label, name, element_id, rn, unnest(props).key prop from k where n > 1)
select s.survivor survivor_id, v.prop, arg_min(v.element_id, v.rn) donor_id from v join s on s.label = v.label and s.name = v.name group by 1, 2"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p6_found, p6_fused, p6_planted, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_kept)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"p3_found": _P3, "p6_found": _P6}
