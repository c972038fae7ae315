"""Queries over exports, snapshots and comparisons, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.operators import pipeline, text
from filigraph.plans.workloads import _FACES, _FILED, _LATEST, _NORMAL, chunks, companies, faces, filed, offers, query
from filigraph.sources import exports
from filigraph.tables import table


@query("select label, count(*) n from (select unnest(labels) label from snapshot_entities) where not starts_with(label, '__') group by 1")
def unwound_labels(s: SparkSession, d: str) -> DataFrame:
    """Rows per label, every label of a row counted, internal ones left out."""
    return table(s, d, "snapshot_entities").select(F.explode("labels").alias("label")).filter(~F.col("label").startswith("__")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select labels[1] as first, count(*) n from snapshot_entities group by 1")
def first_labels(s: SparkSession, d: str) -> DataFrame:
    """Rows per first declared label."""
    return table(s, d, "snapshot_entities").groupBy(F.try_element_at("labels", F.lit(1)).alias("first")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select distinct source, regexp_replace(list_last(string_split(source, '/')), '\.[^.]*$', '') stem, case when contains(source, 'archive/') then list_last(string_split(source, 'archive/')) else source end tail from asset_manager_holdings""")
def source_paths(s: SparkSession, d: str) -> DataFrame:
    """Parts of the source paths of holdings."""
    return table(s, d, "asset_manager_holdings").select("source", exports.file_stem(F.col("source")).alias("stem"), exports.after_marker(F.col("source"), "archive/").alias("tail")).distinct()


@query(f"""with {_FILED} select distinct p.name, coalesce(p.description, '') description from products p where p.companyid in (select src from filed) and p.name <> ''""")
def exported_products(s: SparkSession, d: str) -> DataFrame:
    """Products of companies that filed something, distinct by name and description."""
    edges = exports.of_filers(offers(s, d), filed(s, d))
    return exports.entity_rows(table(s, d, "products").select("productid", "name", "description"), edges, "productid", ["name", "description"])


@query(f"""with {_FACES}, {_FILED}, n as (select dst as name, 'R' || md5(dst) id from faces group by 1) select distinct c.companyid left_id, n.id right_id from faces f join companies c on c.companyid = f.src join n on n.name = f.dst where f.src in (select src from filed)""")
def exported_risks(s: SparkSession, d: str) -> DataFrame:
    """Company-to-risk junction of filers under exported ids."""
    edges = exports.of_filers(faces(s, d), filed(s, d))
    right = edges.select(F.col("dst").alias("name")).distinct().select("name", F.concat(F.lit("R"), F.md5("name")).alias("id"))
    left = companies(s, d).select(F.col("companyid").alias("a"), F.col("companyid").alias("b"))
    return exports.junction(edges, left, right)


@query("select name, max(productid) productid from products where name is not null group by 1")
def product_binding(s: SparkSession, d: str) -> DataFrame:
    """The id that each product name is bound to."""
    return exports.name_binding(table(s, d, "products"), "name", "productid")


def mentioned(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Entity type to (src, dst chunk) of its mentions: companies, products, risk factors by name, and metrics by name."""
    docs = chunks(s, d)
    named = lambda df: df.filter("name is not null").select("name").distinct()
    return {
        "Company": text.mentions(docs, "doc_id", "text", companies(s, d), "name", "companyid"),
        "Product": text.mentions(docs, "doc_id", "text", table(s, d, "products"), "name", "productid"),
        "RiskFactor": text.mentions(docs, "doc_id", "text", faces(s, d).select(F.col("dst").alias("name")).distinct(), "name", "name"),
        "FinancialMetric": text.mentions(docs, "doc_id", "text", named(table(s, d, "financial_metrics")), "name", "name"),
    }


_MENTIONED = f"""w as materialized (select doc_id, {_NORMAL.format("text")} t from documents), nm as (select 'Company' entity_type, companyid id, name from companies union all select 'Product', productid, name from products
union all select distinct 'RiskFactor', dst, dst from faces union all select distinct 'FinancialMetric', name, name from financial_metrics where name is not null),
nn as materialized (select entity_type, id, {_NORMAL.format("name")} n from nm where name is not null), mentioned as (select entity_type, id, doc_id from nn, w where n <> ' ' and contains(t, n))"""


@query(f"with {_FACES}, {_MENTIONED} select entity_type, count(*) n from mentioned group by 1")
def entity_mentions(s: SparkSession, d: str) -> DataFrame:
    """How many chunk mentions each of the four entity types has."""
    return exports.typed_mentions(mentioned(s, d)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select element_id, exported_at, coalesce(name, '') as name, array_to_string(list_filter(labels, lambda x: not starts_with(x, '__')), ',') labels, coalesce(array_to_string(list_sort(list_distinct(list_filter(source_chunks, lambda x: x is not null)))[1:3], '; '), '') chunks,
coalesce(relationship_count, 0) degree from snapshot_entities""")  # fmt: skip
def snapshot_export(s: SparkSession, d: str) -> DataFrame:
    """Entity snapshots with three chunks and their degree."""
    rows = table(s, d, "snapshot_entities")
    cut = exports.entity_snapshot(rows.withColumn("element_id", F.struct("element_id", "exported_at")))
    return cut.select("element_id.element_id", "element_id.exported_at", "name", F.array_join("labels", ",").alias("labels"), F.coalesce(F.array_join("source_chunks", "; "), F.lit("")).alias("chunks"), F.col("relationship_count").alias("degree"))


@query("""with a as (select companyname as name, max(length(managername)) l from asset_manager_holdings where companyname is not null group by 1), b as (select targetcompanyname as name, max(length(sourcecompanyid)) l from company_competitors where targetcompanyname is not null group by 1)
select coalesce(a.name, b.name) as name, case when a.name is null then 'only_b' when b.name is null then 'only_a' else 'both' end "where", case when a.name is not null and b.name is not null then case when coalesce(b.l, 0) > coalesce(a.l, 0) then 'longer' when coalesce(b.l, 0) < coalesce(a.l, 0) then 'shorter' else 'same' end end length
from a full join b on a.name = b.name""")  # fmt: skip
def name_differences(s: SparkSession, d: str) -> DataFrame:
    """Names that two tables share or have alone."""
    a = table(s, d, "asset_manager_holdings").select(F.col("companyname").alias("name"), F.col("managername").alias("body"))
    b = table(s, d, "company_competitors").select(F.col("targetcompanyname").alias("name"), F.col("sourcecompanyid").alias("body"))
    return pipeline.name_differences(a, b, "name", "body")


@query("select c.name company, e.name as executive, e.title from executives e join companies c on c.companyid = e.companyid where e.name is not null order by c.name, e.name, e.title nulls last, e.executiveid limit 50")
def executive_listing(s: SparkSession, d: str) -> DataFrame:
    """The first fifty executives by company and name."""
    rows = table(s, d, "executives").filter("name is not null").select("companyid", F.col("name").alias("executive"), "title", "executiveid")
    joined = rows.join(companies(s, d).select("companyid", F.col("name").alias("company")), "companyid")
    return joined.orderBy("company", "executive", F.asc_nulls_last("title"), "executiveid").limit(50).select("company", "executive", "title")


@query("select c.ticker, m.period, count(*) metrics, count(distinct m.name) kinds from financial_metrics m join companies c on c.companyid = m.companyid where m.period <> '' group by 1, 2")
def metrics_by_period(s: SparkSession, d: str) -> DataFrame:
    """Metrics per company and period."""
    rows = table(s, d, "financial_metrics").filter("period <> ''").join(companies(s, d).select("companyid", "ticker"), "companyid")
    return rows.groupBy("ticker", "period").agg(F.count(F.lit(1)).alias("metrics"), F.count_distinct("name").alias("kinds"))


@query("""select productid, left(name, 8) head, case when description is null then 'null' when trim(description) = '' then 'blank' else 'text' end kind, coalesce(companyid, '?') owner, contains(name, 'Anvil') anvil, coalesce(companyid in ('C001', 'C002', 'C017'), false) listed from products""")
def product_projection(s: SparkSession, d: str) -> DataFrame:
    """Projection, cases, defaults and membership over products."""
    kind = F.when(F.col("description").isNull(), "null").when(F.trim("description") == "", "blank").otherwise("text")
    listed = F.coalesce(F.col("companyid").isin("C001", "C002", "C017"), F.lit(False))
    return table(s, d, "products").select("productid", F.left("name", F.lit(8)).alias("head"), kind.alias("kind"), F.coalesce("companyid", F.lit("?")).alias("owner"), F.contains("name", F.lit("Anvil")).alias("anvil"), listed.alias("listed"))


@query(f"""with {_LATEST} select label, count(*) entities, round(avg(filled), 4) filled, round(sum(coalesce(relationship_count, 0)) / count(*), 4) degree from latest group by 1""")
def graph_ratios(s: SparkSession, d: str) -> DataFrame:
    """Per label the entities, their mean number of properties and their mean degree."""
    from filigraph.plans.workloads import _latest

    return _latest(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("filled"), 4).alias("filled"), F.round(F.sum(F.coalesce("relationship_count", F.lit(0))) / F.count(F.lit(1)), 4).alias("degree"))


@query("""with r as (select managercik, reportcalendarorquarter, upper(trim(ticker)) ticker, max_by(shares, (received_at, source, shares)) shares from asset_manager_holdings where shares is not null and ticker is not null and managercik is not null group by 1, 2, 3)
select managercik, ticker, count(*) as quarters, cast(sum(shares) as bigint) shares from r group by 1, 2""")  # fmt: skip
def late_filings_last(s: SparkSession, d: str) -> DataFrame:
    """Per manager and ticker the quarters and shares, late rows replacing earlier ones of their quarter."""
    rows = table(s, d, "asset_manager_holdings").filter("shares is not null and ticker is not null and managercik is not null")
    last = rows.groupBy("managercik", "reportcalendarorquarter", F.upper(F.trim("ticker")).alias("ticker")).agg(F.max_by("shares", F.struct("received_at", "source", "shares")).alias("shares"))
    return last.groupBy("managercik", "ticker").agg(F.count(F.lit(1)).alias("quarters"), F.sum("shares").alias("shares"))
