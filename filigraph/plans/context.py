"""Queries that put retrieval hits into the context of the graph, further workloads, exports and checks, each with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.operators import fulltext, match, mutate, pipeline
from filigraph.plans.exported import _MENTIONED, mentioned
from filigraph.plans.workloads import _ALL_HITS, _CHAIN, _COMPETES, _FACES, _FILED, _OWNS, _all_similar_chunks, chunks, companies, competes, faces, filings_graph, next_chunk, owns, query, risks
from filigraph.sources import exports
from filigraph.sources.files import with_surrogate_ids
from filigraph.tables import table

# ---- vector hits with their context ----


@query(f"""with {_ALL_HITS}, {_FACES}, {_MENTIONED}, p as (select m.doc_id, list_sort(list(distinct p.name)) l from mentioned m join products p on p.productid = m.id where entity_type = 'Product' group by 1),
r as (select doc_id, list_sort(list(distinct id)) l from mentioned where entity_type = 'RiskFactor' group by 1)
select h.seedid, h.chunkid, d.documentid, d.filingtype, c.name company, coalesce(array_to_string(p.l, '; '), '') products, coalesce(array_to_string(r.l, '; '), '') risks
from hits h join documents d on d.doc_id = h.doc_id left join companies c on c.companyid = d.companyid left join p on p.doc_id = h.doc_id left join r on r.doc_id = h.doc_id""")  # fmt: skip
def all_similar_with_mentions(s: SparkSession, d: str) -> DataFrame:
    """Hits with document and filer, and the products and risks that the chunk itself names."""
    found = mentioned(s, d)
    products = found["Product"].join(table(s, d, "products").select(F.col("productid").alias("src"), "name"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("products"))
    named = found["RiskFactor"].groupBy(F.col("dst").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("src")), "; ").alias("risks"))
    rows = _all_similar_chunks(s, d).join(chunks(s, d).select("doc_id", "documentid", "filingtype", "companyid"), "doc_id")
    rows = rows.join(companies(s, d).select("companyid", F.col("name").alias("company")), "companyid", "left").join(products, "doc_id", "left").join(named, "doc_id", "left")
    return rows.select("seedid", "chunkid", "documentid", "filingtype", "company", *(F.coalesce(c, F.lit("")).alias(c) for c in ("products", "risks")))


@query(f"""with {_ALL_HITS}, {_FACES}, r as (select src, list_sort(list(distinct dst)) l from faces group by 1), p as (select companyid, list_sort(list(distinct name)) l from products where name is not null group by 1)
select h.seedid, h.chunkid, round(h.c, 6) cosine, c.name company, c.ticker, coalesce(array_to_string(r.l[1:5], '; '), '') risks, coalesce(array_to_string(p.l[1:5], '; '), '') products
from hits h join documents d on d.doc_id = h.doc_id join companies c on c.companyid = d.companyid left join r on r.src = c.companyid left join p on p.companyid = c.companyid""")  # fmt: skip
def all_similar_with_filers(s: SparkSession, d: str) -> DataFrame:
    """Hits with their filer and five of its risks and products; each side is reduced before it is joined."""
    r = faces(s, d).groupBy(F.col("src").alias("companyid")).agg(match.first_few(F.col("dst"), 5).alias("r"))
    p = table(s, d, "products").filter("companyid is not null").groupBy("companyid").agg(match.first_few(F.col("name"), 5).alias("p"))
    rows = _all_similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid"), "doc_id").join(companies(s, d).select("companyid", F.col("name").alias("company"), "ticker"), "companyid").join(r, "companyid", "left").join(p, "companyid", "left")
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return rows.select("seedid", "chunkid", "cosine", "company", "ticker", joined("r").alias("risks"), joined("p").alias("products"))


@query(f"""with {_ALL_HITS}, x as (select element_id, arg_max({{'n': name, 'c': map_extract(properties, 'company')[1]}}, exported_at) r0 from snapshot_entities where label = 'RiskFactor' group by 1),
r as (select c.companyid, list_sort(list(x.r0.n)) l from x join companies c on c.name = x.r0.c where trim(x.r0.n) <> '' group by 1)
select h.seedid, h.chunkid, c.name company, array_to_string(r.l, '; ') risks, len(r.l) as n from hits h join documents d on d.doc_id = h.doc_id join companies c on c.companyid = d.companyid join r on r.companyid = c.companyid""")  # fmt: skip
def all_similar_with_all_risks(s: SparkSession, d: str) -> DataFrame:
    """Hits with every risk record of their filer, repeats and all; hits whose filer has none drop out."""
    named = companies(s, d).select("companyid", F.col("name").alias("company"))
    every = risks(s, d).filter("trim(name) <> ''").join(named, "company").groupBy("companyid", "company").agg(F.array_sort(F.collect_list("name")).alias("r"))
    rows = _all_similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid"), "doc_id").join(every, "companyid")
    return rows.select("seedid", "chunkid", "company", F.array_join("r", "; ").alias("risks"), F.size("r").cast("bigint").alias("n"))


# ---- full text ----

_POSTED = """posted as (select doc_id, len(l) length, term, count(*) tf from (select doc_id, l, unnest(l) term from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') l from documents where text is not null)) group by 1, 2, 3),
size as (select count(*) docs, avg(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) mean from documents where text is not null)"""
_RANK = "sum(ln(1 + (size.docs - g.df + 0.5) / (g.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / size.mean)))"


@query(f"with {_POSTED} select doc_id, length, term, tf from posted")
def postings_index(s: SparkSession, d: str) -> DataFrame:
    """The postings of all passages, to be stored and searched."""
    return fulltext.postings(table(s, d, "documents"), "doc_id", "text")


@query(f"""with {_POSTED}, q as (select distinct term from posted where regexp_full_match(term, '[a-z0-9]+') and levenshtein(term, 'supplier') <= 2), g as (select term, count(*) df from posted join q using (term) group by 1)
select p.doc_id, round({_RANK}, 4) score from posted p join g on g.term = p.term, size group by 1""")  # fmt: skip
def fuzzy_search(s: SparkSession, d: str) -> DataFrame:
    """Passages ranked for all words within two edits of a term."""
    docs = table(s, d, "documents")
    index = fulltext.postings(docs, "doc_id", "text")
    near = index.select("term").distinct().filter(F.col("term").rlike("^[a-z0-9]+$") & (F.levenshtein("term", F.lit("supplier"), 2) >= 0))  # the SQL counts bytes, not letters
    return fulltext.bm25_postings(index, "doc_id", near, *fulltext.corpus_size(docs, "text")).select("doc_id", F.round("score", 4).alias("score"))


_NAMED = """named as (select 'Company' label, companyid id, name from companies union all select 'Product', productid, name from products union all select 'Executive', executiveid, name from executives),
w as (select label || ':' || id as key, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') l from named where name is not null), size as (select count(*) docs, avg(len(l)) mean from w),
p as (select key, len(l) length, x.q term, len(list_filter(l, lambda y: y = x.q)) tf from w, (values ('united'), ('anvil')) x(q) where list_contains(l, x.q)), g as (select term, count(*) df from p group by 1)"""


@query(f"with {_NAMED} select key, round({_RANK}, 4) score from p join g on g.term = p.term, size group by 1")
def entity_hits(s: SparkSession, d: str) -> DataFrame:
    """Entities of several labels ranked by words of their names, with their label."""
    one = lambda label, df, key: df.select(F.concat(F.lit(f"{label}:"), F.col(key)).alias("key"), "name")
    rows = reduce(DataFrame.unionByName, [one("Company", companies(s, d), "companyid"), one("Product", table(s, d, "products"), "productid"), one("Executive", table(s, d, "executives"), "executiveid")])
    return fulltext.bm25(rows, "key", "name", ["united", "anvil"]).select("key", F.round("score", 4).alias("score"))


@query(f"""with {_POSTED}, q as (select * from (values ('currency'), ('suppliers')) x(term)), g as (select term, count(*) df from posted join q using (term) group by 1),
top as (select p.doc_id, {_RANK} score from posted p join g on g.term = p.term, size group by 1 order by round(score, 6) desc, p.doc_id limit 10), l as (select companyid, list_sort(list(distinct name)) l from products where name is not null group by 1)
select t.doc_id, c.name company, coalesce(array_to_string(l.l, '; '), '') products from top t join documents d on d.doc_id = t.doc_id join companies c on c.companyid = d.companyid left join l on l.companyid = c.companyid""")  # fmt: skip
def search_with_product_lists(s: SparkSession, d: str) -> DataFrame:
    """The ten best passages of a keyword search with their filer and all its products."""
    hits = fulltext.bm25(table(s, d, "documents"), "doc_id", "text", ["currency", "suppliers"]).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(10)
    offered = table(s, d, "products").filter("name is not null and companyid is not null").groupBy("companyid").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("products"))
    rows = hits.join(chunks(s, d).select("doc_id", "companyid"), "doc_id").join(companies(s, d).select("companyid", F.col("name").alias("company")), "companyid").join(offered, "companyid", "left")
    return rows.select("doc_id", "company", F.coalesce("products", F.lit("")).alias("products"))


# ---- workloads ----


@query(f"""with {_FACES}, {_OWNS}, m as (select src, count(distinct dst) n from owns group by 1 order by n desc, src limit 1), h as (select distinct o.dst from owns o join m on m.src = o.src)
select f.dst risk, string_agg(c.ticker, ',' order by c.ticker) exposed, count(*) cnt from h join faces f on f.src = h.dst join companies c on c.companyid = h.dst group by 1 order by cnt desc, risk limit 10""")  # fmt: skip
def portfolio_exposure(s: SparkSession, d: str) -> DataFrame:
    """The ten risks that most companies of the largest portfolio face, with these companies."""
    held = owns(s, d).select("src", "dst").distinct()
    largest = held.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1)
    rows = held.join(F.broadcast(largest.select("src")), "src", "left_semi").select(F.col("dst").alias("companyid"))
    rows = rows.join(faces(s, d).select(F.col("src").alias("companyid"), F.col("dst").alias("risk")), "companyid").join(companies(s, d).select("companyid", "ticker"), "companyid")
    return rows.groupBy("risk").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("exposed"), F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "risk").limit(10)


@query(f"""with {_FACES}, {_OWNS}, w as (select dst, list_sort(list(distinct src)) l from owns group by 1)
select c.name company, c.ticker, f.dst risk, coalesce(array_to_string(w.l, ','), '') owners from faces f join companies c on c.companyid = f.src left join w on w.dst = c.companyid where contains(f.dst, 'disruption')""")  # fmt: skip
def risk_owner_lists(s: SparkSession, d: str) -> DataFrame:
    """Companies that face a risk whose name contains a word, with the list of their owners."""
    held = owns(s, d).groupBy(F.col("dst").alias("companyid")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("owners"))
    hit = faces(s, d).filter(F.col("dst").contains("disruption")).select(F.col("src").alias("companyid"), F.col("dst").alias("risk"))
    return hit.join(companies(s, d), "companyid").join(held, "companyid", "left").select(F.col("name").alias("company"), "ticker", "risk", F.coalesce("owners", F.lit("")).alias("owners"))


_RISKS = """x as (select element_id, arg_max({'n': name, 'c': map_extract(properties, 'company')[1], 'd': map_extract(properties, 'description')[1]}, exported_at) r from snapshot_entities where label = 'RiskFactor' group by 1)"""


@query(f"""with {_RISKS} select c.name company, x.r.n risk, x.r.d description from x join companies c on c.name = x.r.c where trim(x.r.n) <> '' order by c.name, x.r.n, x.r.d nulls last, x.element_id limit 50""")
def risk_descriptions(s: SparkSession, d: str) -> DataFrame:
    """Risks with their descriptions, the first fifty by company."""
    named = companies(s, d).select(F.col("name").alias("company"))
    rows = risks(s, d).filter("trim(name) <> ''").join(named, "company")
    return rows.orderBy("company", "name", F.asc_nulls_last("description"), "riskid").limit(50).select("company", F.col("name").alias("risk"), "description")


@query(f"""with {_CHAIN}, f as (select doc_id, documentid, chunkindex, text from documents order by documentid nulls last, chunkindex nulls last, doc_id limit 25)
select f.documentid, f.chunkindex idx, left(f.text, 60) preview, n.chunkindex next_idx from f left join chain c on c.src = f.doc_id left join documents n on n.doc_id = c.dst""")  # fmt: skip
def chunk_walk_limited_first(s: SparkSession, d: str) -> DataFrame:
    """Twenty-five chunks, then the next chunk of each: the limit is before the optional hop."""
    first = chunks(s, d).orderBy(F.asc_nulls_last("documentid"), F.asc_nulls_last("chunkindex"), "doc_id").limit(25)
    after = chunks(s, d).select(F.col("doc_id").alias("dst"), F.col("chunkindex").alias("next_idx"))
    rows = first.join(next_chunk(s, d).withColumnRenamed("src", "doc_id"), "doc_id", "left").join(after, "dst", "left")
    return rows.select("documentid", F.col("chunkindex").alias("idx"), F.left("text", F.lit(60)).alias("preview"), "next_idx")


@query(f"""with {_CHAIN} select d.documentid, d.chunkindex idx, left(d.text, 80) preview, n.chunkindex next_idx from documents d left join chain c on c.src = d.doc_id left join documents n on n.doc_id = c.dst
where d.documentid is not null order by d.chunkindex nulls last, d.documentid, d.doc_id limit 40""")  # fmt: skip
def chunk_walk_limited_last(s: SparkSession, d: str) -> DataFrame:
    """Chunks with the next one of each, then forty of them: the limit is after the optional hop."""
    rows = chunks(s, d).filter("documentid is not null")
    after = chunks(s, d).select(F.col("doc_id").alias("dst"), F.col("chunkindex").alias("next_idx"))
    joined = rows.join(next_chunk(s, d).withColumnRenamed("src", "doc_id"), "doc_id", "left").join(after, "dst", "left")
    return joined.orderBy(F.asc_nulls_last("chunkindex"), "documentid", "doc_id").limit(40).select("documentid", F.col("chunkindex").alias("idx"), F.left("text", F.lit(80)).alias("preview"), "next_idx")


@query(f"""with {_FACES}, {_MENTIONED} select entity_type, id, count(*) mentions from mentioned group by 1, 2 order by mentions desc, entity_type, id limit 10""")
def entities_by_mentions(s: SparkSession, d: str) -> DataFrame:
    """The ten entities that most chunks name, of whatever type."""
    rows = exports.typed_mentions(mentioned(s, d)).groupBy("entity_type", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    return rows.orderBy(F.desc("mentions"), "entity_type", "id").limit(10)


@query(f"""with {_FACES}, {_FILED}, p as (select companyid, count(*) n from products group by 1), r as (select src, count(*) n from faces group by 1), f as (select src, count(*) n from filed group by 1)
select c.name company, c.ticker, coalesce(p.n, 0) products, coalesce(r.n, 0) risks, coalesce(f.n, 0) documents from companies c left join p on p.companyid = c.companyid left join r on r.src = c.companyid left join f on f.src = c.companyid""")  # fmt: skip
def structured_overview(s: SparkSession, d: str) -> DataFrame:
    """Per company its products, risks and documents."""
    graph = filings_graph(s, d)
    rows = companies(s, d)
    for name, kind in (("products", "OFFERS"), ("risks", "FACES_RISK"), ("documents", "FILED")):
        rows = match.optional_count(rows, "companyid", graph.edges[kind], name)
    return rows.select(F.col("name").alias("company"), "ticker", "products", "risks", "documents")


@query(f"""with {_CHAIN}, {_FACES}, {_MENTIONED}, p as (select m.doc_id, list_sort(list(distinct p.name)) l from mentioned m join products p on p.productid = m.id where entity_type = 'Product' group by 1)
select d.documentid, d.chunkindex idx, n.chunkindex next_idx, left(d.text, 60) preview, coalesce(array_to_string(p.l, '; '), '') products
from documents d left join chain c on c.src = d.doc_id left join documents n on n.doc_id = c.dst left join p on p.doc_id = d.doc_id where d.documentid is not null""")  # fmt: skip
def chunk_walk_with_products(s: SparkSession, d: str) -> DataFrame:
    """The chunks of each document with the next one and the products that they name."""
    named = mentioned(s, d)["Product"].join(table(s, d, "products").select(F.col("productid").alias("src"), "name"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("products"))
    rows = chunks(s, d).filter("documentid is not null")
    after = chunks(s, d).select(F.col("doc_id").alias("dst"), F.col("chunkindex").alias("next_idx"))
    joined = rows.join(next_chunk(s, d).withColumnRenamed("src", "doc_id"), "doc_id", "left").join(after, "dst", "left").join(named, "doc_id", "left")
    return joined.select("documentid", F.col("chunkindex").alias("idx"), "next_idx", F.left("text", F.lit(60)).alias("preview"), F.coalesce("products", F.lit("")).alias("products"))


# ---- exports ----


@query("""select 'CH' || lpad(cast(r as varchar), cast(greatest(3, length(cast(r as varchar))) as integer), '0') id, documentid, chunkindex, doc_id from (select *, row_number() over (order by documentid, chunkindex, doc_id) r from documents where documentid is not null)""")
def exported_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks under exported ids in the order of document and index."""
    rows = table(s, d, "documents").filter("documentid is not null").select("documentid", "chunkindex", "doc_id")
    return with_surrogate_ids(rows, ["documentid", "chunkindex", "doc_id"], "CH", "id").select("id", "documentid", "chunkindex", "doc_id")


@query("""with i as (select doc_id, documentid, chunkindex, row_number() over (order by documentid, chunkindex, doc_id) r from documents where documentid is not null), u as (select documentid, chunkindex, max(r) r from i group by 1, 2)
select u.r chunk_number, e.chunkid from nova_embeddings e join documents d on d.doc_id = e.doc_id join u on u.documentid = d.documentid and u.chunkindex = d.chunkindex""")  # fmt: skip
def rekeyed_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Vectors re-keyed to exported chunk numbers by document and index, the last one where an index is there twice."""
    rows = table(s, d, "documents").filter("documentid is not null").select("documentid", "chunkindex", "doc_id")
    ids = with_surrogate_ids(rows, ["documentid", "chunkindex", "doc_id"], "", "id").select("documentid", "chunkindex", F.col("id").cast("bigint").alias("chunk_number"))
    last = ids.groupBy("documentid", "chunkindex").agg(F.max("chunk_number").alias("chunk_number"))
    return table(s, d, "nova_embeddings").select("chunkid", "doc_id").join(rows, "doc_id").join(last, ["documentid", "chunkindex"]).select("chunk_number", "chunkid")


_BOUND = "(select name, max({0}) id from {1} where name is not null group by 1)"


@query(f"""with {_FACES}, {_OWNS}, {_COMPETES}, {_FILED}, c as (select name, max(companyid) id from companies where name is not null group by 1), k as (select companyid, id from companies join c using (name)),
j as (select distinct 'OFFERS' as type, k.id l, b.id r from products t join k on k.companyid = t.companyid join {_BOUND.format("productid", "products")} b on b.name = t.name
union all select distinct 'HAS_EXECUTIVE', k.id, b.id from executives t join k on k.companyid = t.companyid join {_BOUND.format("executiveid", "executives")} b on b.name = t.name
union all select distinct 'REPORTS', k.id, b.id from financial_metrics t join k on k.companyid = t.companyid join {_BOUND.format("metricid", "financial_metrics")} b on b.name = t.name
union all select distinct 'FACES_RISK', k.id, 'R' || md5(f.dst) from faces f join k on k.companyid = f.src union all select distinct 'OWNS', o.src, k.id from owns o join k on k.companyid = o.dst
union all select distinct 'COMPETES_WITH', a.id, b.id from competes e join k a on a.companyid = e.src join k b on b.companyid = e.dst union all select distinct 'FILED', k.id, f.dst from filed f join k on k.companyid = f.src)
select type, l left_id, r right_id from j""")  # fmt: skip
def exported_junctions(s: SparkSession, d: str) -> DataFrame:
    """Seven junctions re-keyed by name: the id of a name is the last one that has it, edges without a name drop out."""
    known = companies(s, d).filter("name is not null")
    company = known.select("companyid", "name").join(exports.name_binding(known, "name", "companyid").withColumnRenamed("companyid", "id"), "name").select("companyid", "id")

    def own(kind: str, t: str, key: str) -> DataFrame:
        rows = table(s, d, t).filter("name is not null and companyid is not null").select(F.col("companyid").alias("src"), F.col("name").alias("dst"))
        return exports.junction(rows, company, exports.name_binding(table(s, d, t), "name", key)).withColumn("type", F.lit(kind))

    same = lambda df, c: df.select(F.col(c).alias("k"), F.col(c).alias("id")).distinct()
    held, facing, graph = owns(s, d).select("src", "dst").distinct(), faces(s, d), filings_graph(s, d)
    parts = [own("OFFERS", "products", "productid"), own("HAS_EXECUTIVE", "executives", "executiveid"), own("REPORTS", "financial_metrics", "metricid")]
    parts.append(exports.junction(facing, company, facing.select("dst").distinct().select("dst", F.concat(F.lit("R"), F.md5("dst")).alias("id"))).withColumn("type", F.lit("FACES_RISK")))
    parts.append(exports.junction(held, same(held, "src"), company).withColumn("type", F.lit("OWNS")))
    parts.append(exports.junction(competes(s, d), company, company).withColumn("type", F.lit("COMPETES_WITH")))
    parts.append(exports.junction(graph.edges["FILED"], company, same(graph.edges["FILED"], "dst")).withColumn("type", F.lit("FILED")))
    return reduce(DataFrame.unionByName, parts).select("type", "left_id", "right_id")


@query("""select label, k as property, count(*) n from (select label, unnest(map_entries(properties)).key k, unnest(map_entries(properties)).value v from snapshot_entities) where not starts_with(k, '__') and k <> 'embedding' and v is not null group by 1, 2""")
def model_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Per label and public property how many entities have it: what a model extracted."""
    rows = table(s, d, "snapshot_entities").select("label", F.explode("properties").alias("property", "v")).filter("v is not null")
    return rows.filter(~F.col("property").startswith("__") & (F.col("property") != "embedding")).groupBy("label", "property").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select distinct managercik src, 'OWNS' as type, companyname dst from asset_manager_holdings where companyname is not null and managercik is not null and position_status = 'current'),
b as (select distinct managercik src, 'OWNS' as type, companyname dst from asset_manager_holdings where companyname is not null and managercik is not null and coalesce(position_status, '') <> 'current')
select case when b.src is null then 'only_a' when a.src is null then 'only_b' else 'both' end "where", count(*) n from a full join b on a.src = b.src and a.type = b.type and a.dst = b.dst group by 1""")  # fmt: skip
def triple_differences(s: SparkSession, d: str) -> DataFrame:
    """How many holdings, as triples, current and former positions share or have alone."""
    rows = table(s, d, "asset_manager_holdings").filter("companyname is not null and managercik is not null").select(F.col("managercik").alias("src"), F.lit("OWNS").alias("type"), F.col("companyname").alias("dst"), (F.coalesce("position_status", F.lit("")) == "current").alias("now"))
    found = pipeline.triple_differences(rows.filter("now").drop("now"), rows.filter("not now").drop("now"))
    return found.groupBy("where").agg(F.count(F.lit(1)).alias("n"))


# ---- changes ----


@query(f"""with {_FACES}, {_MENTIONED} select distinct d.companyid src, m.id dst from mentioned m join documents d on d.doc_id = m.doc_id where m.entity_type = 'Company' and d.companyid is not null and d.companyid <> m.id""")
def rivals_by_mention(s: SparkSession, d: str) -> DataFrame:
    """Companies that are named in a chunk which another company filed."""
    filers = chunks(s, d).filter("companyid is not null").select(F.col("doc_id").alias("chunk"), F.col("companyid").alias("company"))
    return mutate.rivals_by_mention(mentioned(s, d)["Company"], filers)


@query("""select element_id, exported_at, coalesce(map_extract(properties, 'segment')[1], '') old_segment, len(list_distinct(list_concat(coalesce(map_keys(map_from_entries(list_filter(map_entries(properties), lambda e: e.key <> 'segment'))), []), ['reviewed']))) keys from snapshot_entities""")
def added_properties(s: SparkSession, d: str) -> DataFrame:
    """Properties put over those that are there: one is set, one is taken away, the others stay."""
    rows = table(s, d, "snapshot_entities").withColumn("new", mutate.add_properties(F.col("properties"), {"reviewed": F.lit("yes"), "segment": F.lit(None).cast("string")}))
    return rows.select("element_id", "exported_at", F.coalesce(F.try_element_at("properties", F.lit("segment")), F.lit("")).alias("old_segment"), F.size("new").cast("bigint").alias("keys"))


@query("select sourcecompanyid src, targetcompanyid dst, count(*) n from (select sourcecompanyid, targetcompanyid from company_competitors where targetcompanyid <> '' union all select companyid, productid from products where companyid is not null) group by 1, 2")
def created_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges created without a look at those that are there: how often each is there."""
    rows = table(s, d, "company_competitors").filter("targetcompanyid <> ''").select(F.col("sourcecompanyid").alias("src"), F.col("targetcompanyid").alias("dst"))
    more = table(s, d, "products").filter("companyid is not null").select(F.col("companyid").alias("src"), F.col("productid").alias("dst"))
    return mutate.create_rows(rows, more).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select * from (values ('Leferedat Software Inc.', 'Drufugratax Software LLC'), ('Nobody Ltd', 'Leferedat Software Inc.')) t(gone, stays)),
f as (select name, min(companyid) id from companies group by 1) select a.id, b.id survivor from p join f a on a.name = p.gone join f b on b.name = p.stays""")  # fmt: skip
def listed_merges(s: SparkSession, d: str) -> DataFrame:
    """Merges of a fixed list of names; a pair of which one is missing is skipped."""
    return mutate.listed_merges(companies(s, d), "companyid", "name", [("Leferedat Software Inc.", "Drufugratax Software LLC"), ("Nobody Ltd", "Leferedat Software Inc.")])


# ---- filters on types and labels ----


@query(f"""with {_FACES}, {_COMPETES} select src, count(*) n from (select src, dst from competes union all select src, dst from faces union all select companyid, productid from products where companyid is not null) group by 1""")
def edges_of_types(s: SparkSession, d: str) -> DataFrame:
    """Edges of some types per node that they start from, over the generic view of all edges."""
    return filings_graph(s, d).all_edges().filter(F.col("type").isin("COMPETES_WITH", "FACES_RISK", "OFFERS")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("""select label, count(*) n from snapshot_entities where not (list_contains(labels, 'Company') and list_contains(labels, '__Entity__')) and not list_contains(labels, 'Product') group by 1""")
def label_predicate(s: SparkSession, d: str) -> DataFrame:
    """Entities that do not have two labels at once, nor a third."""
    has = lambda x: F.array_contains("labels", x)
    return table(s, d, "snapshot_entities").filter(~(has("Company") & has("__Entity__")) & ~has("Product")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
