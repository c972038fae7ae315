"""Named queries over the filings graph and the star tables, each with SQL that gives the same rows.

The graph is a set of frames over the tables: companies, products, executives, metrics, managers and their holdings,
competitors, risk factors, documents and their chunks. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigraph.functions import expressions as X
from filigraph.graph import Graph
from filigraph.operators import checks, fulltext, match, mutate, resolve, retrieve, text
from filigraph.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Name to query."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return dict(_SQL)


# ---- the graph ----


def companies(s: SparkSession, d: str) -> DataFrame:
    """Company nodes."""
    return table(s, d, "companies").select("companyid", "name", "ticker", "cik", "cusip")


def offers(s: SparkSession, d: str) -> DataFrame:
    """Company to product."""
    return table(s, d, "products").filter("companyid is not null").select(F.col("companyid").alias("src"), F.col("productid").alias("dst"))


def competes(s: SparkSession, d: str) -> DataFrame:
    """Company to competitor, for target ids that are exactly those of companies; each pair once."""
    rows = table(s, d, "company_competitors").select(F.col("sourcecompanyid").alias("src"), F.col("targetcompanyid").alias("dst"))
    known = companies(s, d)
    return mutate.merge_edges(rows, known, "companyid", known, "companyid")


def owns(s: SparkSession, d: str) -> DataFrame:
    """Manager to company with shares, matched by ticker; every filed position is an edge."""
    rows = table(s, d, "asset_manager_holdings").select("managercik", "managername", F.upper(F.trim("ticker")).alias("ticker"), "shares", "received_at", "source")
    return rows.filter("ticker is not null and managercik is not null").join(companies(s, d).select("companyid", "ticker"), "ticker").select(F.col("managercik").alias("src"), F.col("companyid").alias("dst"), "shares", "received_at", "source", "managername")


def risks(s: SparkSession, d: str) -> DataFrame:
    """Risk factors with the company that they are filed under; the latest export of each element."""
    rows = table(s, d, "snapshot_entities").filter("label = 'RiskFactor'")
    last = rows.groupBy("element_id").agg(F.max_by(F.struct("name", F.try_element_at("properties", F.lit("company")).alias("company"), F.try_element_at("properties", F.lit("description")).alias("description")), "exported_at").alias("r"))
    return last.select(F.col("element_id").alias("riskid"), "r.name", "r.company", "r.description")


def faces(s: SparkSession, d: str) -> DataFrame:
    """Company to name of a risk factor, once each."""
    named = companies(s, d).select("companyid", F.col("name").alias("company"))
    return risks(s, d).filter("name is not null and trim(name) <> ''").join(named, "company").select(F.col("companyid").alias("src"), F.col("name").alias("dst")).distinct()


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks: the passages of documents."""
    return table(s, d, "documents").select("doc_id", "documentid", "companyid", "chunkindex", "text", "source", "filingtype")


def filed(s: SparkSession, d: str) -> DataFrame:
    """Company to document, once each."""
    return chunks(s, d).filter("companyid is not null and documentid is not null").select(F.col("companyid").alias("src"), F.col("documentid").alias("dst")).distinct()


def next_chunk(s: SparkSession, d: str) -> DataFrame:
    """Chunk to the next chunk of its document."""
    return text.chunk_chain(chunks(s, d), "documentid", "chunkindex", "doc_id")


def filings_graph(s: SparkSession, d: str) -> Graph:
    """All labels and edge types; risk factors are nodes by name, managers by CIK."""
    docs = chunks(s, d).filter("documentid is not null")
    nodes = {
        "Company": companies(s, d),
        "Product": table(s, d, "products").select("productid", "name", "description"),
        "Executive": table(s, d, "executives").select("executiveid", "name", "title"),
        "FinancialMetric": table(s, d, "financial_metrics").select("metricid", "name", "value", "period"),
        "RiskFactor": faces(s, d).select(F.col("dst").alias("riskname")).distinct(),
        "AssetManager": table(s, d, "asset_manager_holdings").filter("managercik is not null").groupBy(F.col("managercik").alias("managerid")).agg(F.min("managername").alias("name")),
        "Document": docs.groupBy("documentid").agg(F.min("filingtype").alias("filingtype"), F.min("source").alias("source")),
        "Chunk": chunks(s, d).select(F.col("doc_id").cast("string").alias("chunkid"), "chunkindex"),
    }
    own = lambda t, key: table(s, d, t).filter("companyid is not null").select(F.col("companyid").alias("src"), F.col(key).alias("dst"))
    edges = {
        "OFFERS": offers(s, d), "HAS_EXECUTIVE": own("executives", "executiveid"), "REPORTS": own("financial_metrics", "metricid"), "COMPETES_WITH": competes(s, d),
        "OWNS": owns(s, d).select("src", "dst").distinct(), "FACES_RISK": faces(s, d), "FILED": filed(s, d),
        "FROM_DOCUMENT": docs.select(F.col("doc_id").cast("string").alias("src"), F.col("documentid").alias("dst")),
        "NEXT_CHUNK": next_chunk(s, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")),
    }
    return Graph(nodes, edges)


_FACES = """faces as (select distinct c.companyid src, r.name dst from (
  select element_id, arg_max({'n': name, 'c': map_extract(properties, 'company')[1]}, exported_at) r0 from snapshot_entities where label = 'RiskFactor' group by 1) x
  cross join lateral (select x.r0.n as name, x.r0.c as company) r join companies c on c.name = r.company where r.name is not null and trim(r.name) <> '')"""
_OWNS = "owns as (select h.managercik src, c.companyid dst, h.shares, h.received_at, h.source, h.managername from asset_manager_holdings h join companies c on c.ticker = upper(trim(h.ticker)) where h.managercik is not null)"
_COMPETES = "competes as (select distinct k.sourcecompanyid src, k.targetcompanyid dst from company_competitors k join companies a on a.companyid = k.sourcecompanyid join companies b on b.companyid = k.targetcompanyid)"
_CHAIN = "chain as (select * from (select doc_id src, lead(doc_id) over (partition by documentid order by chunkindex, doc_id) dst from documents where documentid is not null) where dst is not null)"
_FILED = "filed as (select distinct companyid src, documentid dst from documents where companyid is not null and documentid is not null)"

# ---- direct traversals ----


@query("select p.name from products p join companies c on c.companyid = p.companyid where c.ticker = 'LEER'")
def products_of_ticker(s: SparkSession, d: str) -> DataFrame:
    """Products that the company with a ticker offers."""
    one = companies(s, d).filter("ticker = 'LEER'").select("companyid", "ticker")
    return match.hop(one, "companyid", offers(s, d), table(s, d, "products").select("productid", "name"), "productid").select("name")


@query(f"""with {_FACES}, n as (select dst risk, string_agg(ticker, ',' order by ticker) companies, count(*) cnt from faces join companies c on c.companyid = src group by 1 having count(*) > 1)
select risk, companies, cnt from n order by cnt desc, risk limit 10""")  # fmt: skip
def shared_risks(s: SparkSession, d: str) -> DataFrame:
    """Risk factors that more than one company faces: the ten most shared, with tickers."""
    rows = faces(s, d).join(companies(s, d).select(F.col("companyid").alias("src"), "ticker"), "src")
    per = rows.groupBy(F.col("dst").alias("risk")).agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("companies"), F.count(F.lit(1)).alias("cnt"))
    return per.filter("cnt > 1").orderBy(F.desc("cnt"), "risk").limit(10)


@query(f"""with {_FACES}, {_OWNS} select o.src manager, count(distinct f.dst) risks, count(distinct o.dst) exposed from owns o join faces f on f.src = o.dst group by 1""")
def manager_exposure(s: SparkSession, d: str) -> DataFrame:
    """Per manager the distinct risks and the exposed companies of its portfolio; edges are reduced before the join."""
    held = owns(s, d).select(F.col("src").alias("manager"), F.col("dst").alias("company")).distinct()
    return held.join(faces(s, d).select(F.col("src").alias("company"), "dst"), "company").groupBy("manager").agg(F.count_distinct("dst").alias("risks"), F.count_distinct("company").alias("exposed"))


@query(f"""with {_FACES}, {_OWNS}, e as (select o.src manager, f.dst risk, count(distinct o.dst) exposed from owns o join faces f on f.src = o.dst group by 1, 2 having count(distinct o.dst) > 1)
select manager, risk, exposed from e order by exposed desc, manager, risk limit 5""")  # fmt: skip
def top_exposures(s: SparkSession, d: str) -> DataFrame:
    """The five largest exposures of a manager to one risk, over more than one company."""
    held = owns(s, d).select(F.col("src").alias("manager"), F.col("dst").alias("company")).distinct()
    per = held.join(faces(s, d).select(F.col("src").alias("company"), F.col("dst").alias("risk")), "company").groupBy("manager", "risk").agg(F.count(F.lit(1)).alias("exposed"))
    return per.filter("exposed > 1").orderBy(F.desc("exposed"), "manager", "risk").limit(5)


@query(f"with {_OWNS} select src manager, count(distinct dst) holdings, cast(sum(shares) as bigint) total_shares from owns group by 1 order by 2 desc, 1 limit 5")
def top_managers(s: SparkSession, d: str) -> DataFrame:
    """The five managers with the most companies, and their shares."""
    per = owns(s, d).groupBy(F.col("src").alias("manager")).agg(F.count_distinct("dst").alias("holdings"), F.sum("shares").alias("total_shares"))
    return per.orderBy(F.desc("holdings"), "manager").limit(5)


@query(f"with {_COMPETES} select k.src, k.dst, exists (select 1 from competes r where r.src = k.dst and r.dst = k.src) mutual from competes k")
def competitors_with_mutual(s: SparkSession, d: str) -> DataFrame:
    """Competitors with a flag: does the competitor name the company too?"""
    edges = competes(s, d)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return match.flagged(edges, ("src", "dst"), back, "mutual")


@query(f"with {_COMPETES} select b.name from competes k join companies a on a.companyid = k.src join companies b on b.companyid = k.dst where a.ticker = 'LEER'")
def competitors_of_ticker(s: SparkSession, d: str) -> DataFrame:
    """Competitors of the company with a ticker."""
    one = companies(s, d).filter("ticker = 'LEER'").select("companyid", "ticker")
    return match.hop(one, "companyid", competes(s, d), companies(s, d).select(F.col("companyid").alias("other"), "name"), "other").select("name")


@query("select distinct c.name company, c.ticker, d.documentid, d.accessionnumber, d.filingtype from documents d join companies c on c.companyid = d.companyid where d.documentid is not null")
def filed_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents with the company that filed them."""
    docs = table(s, d, "documents").filter("documentid is not null").select("companyid", "documentid", "accessionnumber", "filingtype").distinct()
    return docs.join(companies(s, d), "companyid").select(F.col("name").alias("company"), "ticker", "documentid", "accessionnumber", "filingtype")


@query(f"""with {_FACES}, {_OWNS}, w as (select dst, count(distinct src) owners from owns group by 1)
select c.name company, c.ticker, f.dst risk, coalesce(w.owners, 0) owners from faces f join companies c on c.companyid = f.src left join w on w.dst = c.companyid where contains(f.dst, 'disruption')""")  # fmt: skip
def risk_contains(s: SparkSession, d: str) -> DataFrame:
    """Companies facing a risk whose name contains a word, with the number of their owners."""
    hit = faces(s, d).filter(F.col("dst").contains("disruption"))
    rows = hit.join(companies(s, d), hit.src == F.col("companyid")).select("companyid", F.col("name").alias("company"), "ticker", F.col("dst").alias("risk"))
    return match.optional_count(rows, "companyid", owns(s, d), "owners", reverse=True).select("company", "ticker", "risk", "owners")


@query(f"""with {_OWNS} select src manager, dst company, shares, received_at from owns where contains(managername, 'CAPITAL') and shares is not null
order by shares desc, src, dst, received_at limit 20""")  # fmt: skip
def top_positions(s: SparkSession, d: str) -> DataFrame:
    """The twenty largest positions of managers whose name contains a word."""
    rows = owns(s, d).filter(F.col("managername").contains("CAPITAL") & F.col("shares").isNotNull())
    return rows.select(F.col("src").alias("manager"), F.col("dst").alias("company"), "shares", "received_at").orderBy(F.desc("shares"), "manager", "company", "received_at").limit(20)


@query(f"""with {_FACES}, r as (select src companyid, count(*) n from faces group by 1), p as (select companyid, count(*) n from products group by 1), e as (select companyid, count(*) n from executives group by 1), m as (select companyid, count(*) n from financial_metrics group by 1)
select c.name company, c.ticker, coalesce(r.n, 0) risks, coalesce(p.n, 0) products, coalesce(e.n, 0) executives, coalesce(m.n, 0) metrics
from companies c left join r on r.companyid = c.companyid left join p on p.companyid = c.companyid left join e on e.companyid = c.companyid left join m on m.companyid = c.companyid""")  # fmt: skip
def company_overview(s: SparkSession, d: str) -> DataFrame:
    """Per company how many risks, products, executives and metrics it has; optional hops, each counted on its own."""
    own = lambda t, key: table(s, d, t).select(F.col("companyid").alias("src"), F.col(key).alias("dst"))
    rows = match.optional_count(companies(s, d), "companyid", faces(s, d), "risks")
    for name, t, key in (("products", "products", "productid"), ("executives", "executives", "executiveid"), ("metrics", "financial_metrics", "metricid")):
        rows = match.optional_count(rows, "companyid", own(t, key), name)
    return rows.select(F.col("name").alias("company"), "ticker", "risks", "products", "executives", "metrics")


@query("select c.companyid, c.ticker, count(d.doc_id) chunks, count(distinct d.documentid) documents from companies c left join documents d on d.companyid = c.companyid group by 1, 2")
def chunks_per_company(s: SparkSession, d: str) -> DataFrame:
    """Chunks and documents per company, zero where it filed none."""
    edges = chunks(s, d).select(F.col("companyid").alias("src"), "doc_id", "documentid")
    rows = match.optional_collection(companies(s, d), "companyid", edges, chunks=F.count("doc_id"), documents=F.count_distinct("documentid"))
    return rows.select("companyid", "ticker", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""with e as (select distinct doc_id from nova_embeddings where embedding is not null and doc_id is not null)
select d.documentid, count(*) chunks, count(e.doc_id) embedded from documents d left join e on e.doc_id = d.doc_id where d.documentid is not null group by 1""")  # fmt: skip
def embedded_chunks(s: SparkSession, d: str) -> DataFrame:
    """Per document how many chunks it has and how many have an embedding."""
    have = table(s, d, "nova_embeddings").filter("embedding is not null and doc_id is not null").select("doc_id", F.lit(1).alias("hit")).distinct()
    rows = chunks(s, d).filter("documentid is not null").join(have, "doc_id", "left")
    return rows.groupBy("documentid").agg(F.count(F.lit(1)).alias("chunks"), F.count("hit").alias("embedded"))


@query(f"with {_CHAIN} select d.documentid, d.chunkindex idx, left(d.text, 60) preview, n.chunkindex next_idx from documents d left join chain c on c.src = d.doc_id left join documents n on n.doc_id = c.dst where d.documentid is not null")
def chunk_walk(s: SparkSession, d: str) -> DataFrame:
    """Chunks of each document with the index of the next one."""
    rows = chunks(s, d).filter("documentid is not null")
    after = rows.select(F.col("doc_id").alias("dst"), F.col("chunkindex").alias("next_idx"))
    joined = rows.join(next_chunk(s, d), rows.doc_id == F.col("src"), "left").join(after, "dst", "left")
    return joined.select("documentid", F.col("chunkindex").alias("idx"), F.left("text", F.lit(60)).alias("preview"), "next_idx")


@query("select documentid, chunkindex, left(text, 120) preview from documents order by chunkindex, documentid, doc_id limit 10")
def first_chunks(s: SparkSession, d: str) -> DataFrame:
    """The first ten chunks by index."""
    return chunks(s, d).orderBy(F.asc_nulls_last("chunkindex"), F.asc_nulls_last("documentid"), "doc_id").limit(10).select("documentid", "chunkindex", F.left("text", F.lit(120)).alias("preview"))


_NORMAL = "regexp_replace(' ' || lower({}) || ' ', '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"


@query(f"""with w as materialized (select doc_id, {_NORMAL.format('text')} t from documents), c as materialized (select companyid, {_NORMAL.format('name')} n from companies)
select companyid, count(*) mentions from w, c where contains(w.t, c.n) group by 1""")  # fmt: skip
def company_mentions(s: SparkSession, d: str) -> DataFrame:
    """In how many chunks each company is named in full."""
    edges = text.mentions(chunks(s, d), "doc_id", "text", companies(s, d), "name", "companyid")
    return edges.groupBy(F.col("src").alias("companyid")).agg(F.count(F.lit(1)).alias("mentions"))


@query("select c.companyid, d.documentid, d.chunkindex, left(d.text, 100) preview from companies c join documents d on d.companyid = c.companyid where c.ticker = 'LEER'")
def provenance_of_ticker(s: SparkSession, d: str) -> DataFrame:
    """Filer to documents to chunks for one ticker."""
    one = companies(s, d).filter("ticker = 'LEER'").select("companyid")
    return one.join(chunks(s, d), "companyid").select("companyid", "documentid", "chunkindex", F.left("text", F.lit(100)).alias("preview"))


@query(f"""with {_FILED} select count(*) chunks, count(distinct documentid) documents, (select count(distinct src) from filed) filers, count(*) filter (where documentid is null) loose,
count(distinct case when companyid is null then documentid end) unlinked from documents""")  # fmt: skip
def provenance_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of chunks, documents and filers, and what is not linked."""
    return chunks(s, d).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("documentid").alias("documents"),
        F.count_distinct(F.when(F.col("documentid").isNotNull(), F.col("companyid"))).alias("filers"), F.count_if(F.col("documentid").isNull()).alias("loose"),
        F.count_distinct(F.when(F.col("companyid").isNull(), F.col("documentid"))).alias("unlinked"),
    )


@query(f"""with {_FACES} select 'Company' label, count(*) nodes from companies union all select 'Product', count(*) from products union all select 'Executive', count(*) from executives
union all select 'FinancialMetric', count(*) from financial_metrics union all select 'RiskFactor', count(distinct dst) from faces union all select 'AssetManager', count(distinct managercik) from asset_manager_holdings
union all select 'Document', count(distinct documentid) from documents union all select 'Chunk', count(*) from documents""")  # fmt: skip
def label_counts(s: SparkSession, d: str) -> DataFrame:
    """Nodes per label."""
    return filings_graph(s, d).label_counts()


@query(f"""with {_FACES}, {_OWNS}, {_COMPETES}, {_CHAIN}, {_FILED}
select 'OFFERS' as type, count(*) edges from products where companyid is not null union all select 'HAS_EXECUTIVE', count(*) from executives where companyid is not null
union all select 'REPORTS', count(*) from financial_metrics where companyid is not null union all select 'COMPETES_WITH', count(*) from competes
union all select 'OWNS', count(*) from (select distinct src, dst from owns) union all select 'FACES_RISK', count(*) from faces union all select 'FILED', count(*) from filed
union all select 'FROM_DOCUMENT', count(*) from documents where documentid is not null union all select 'NEXT_CHUNK', count(*) from chain""")  # fmt: skip
def edge_counts(s: SparkSession, d: str) -> DataFrame:
    """Edges per type."""
    return filings_graph(s, d).edge_counts()


@query(f"""with {_COMPETES}, e as (select src id from competes union all select dst from competes where src <> dst) select id, count(*) degree from e group by 1""")
def competitor_degrees(s: SparkSession, d: str) -> DataFrame:
    """Undirected degree of each company among competitors."""
    return match.degrees(competes(s, d))


@query(f"with {_COMPETES} select companyid, name from companies where companyid not in (select src from competes union select dst from competes)")
def without_competitors(s: SparkSession, d: str) -> DataFrame:
    """Companies that no competitor edge touches in either direction."""
    edges = competes(s, d)
    return match.lacking(match.lacking(companies(s, d), "companyid", edges), "companyid", edges, reverse=True).select("companyid", "name")


@query(f"""with {_FACES}, {_FILED}, r as (select src, list_sort(list(distinct dst)) l from faces group by 1), p as (select companyid, list_sort(list(distinct name)) l from products where name is not null group by 1)
select f.dst documentid, f.src companyid, coalesce(array_to_string(r.l[1:5], '; '), '') risks, coalesce(array_to_string(p.l[1:5], '; '), '') products from filed f left join r on r.src = f.src left join p on p.companyid = f.src""")  # fmt: skip
def document_context(s: SparkSession, d: str) -> DataFrame:
    """Per filed document five risks and five products of its filer, alphabetically; empty where there are none."""
    r = faces(s, d).groupBy("src").agg(match.first_few(F.col("dst"), 5).alias("r"))
    p = table(s, d, "products").filter("companyid is not null").groupBy(F.col("companyid").alias("src")).agg(match.first_few(F.col("name"), 5).alias("p"))
    rows = filed(s, d).join(r, "src", "left").join(p, "src", "left")
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return rows.select(F.col("dst").alias("documentid"), F.col("src").alias("companyid"), joined("r").alias("risks"), joined("p").alias("products"))


@query(f"""with {_FACES}, {_COMPETES} select k.src company, k.dst rival, f.dst risk from competes k join faces f on f.src = k.src join faces g on g.src = k.dst and g.dst = f.dst""")
def risks_in_common(s: SparkSession, d: str) -> DataFrame:
    """Risks that a company shares with a competitor that it names."""
    edges = competes(s, d).select(F.col("src").alias("company"), F.col("dst").alias("rival"))
    risk = faces(s, d)
    own = edges.join(risk.select(F.col("src").alias("company"), F.col("dst").alias("risk")), "company")
    return own.join(risk.select(F.col("src").alias("rival"), F.col("dst").alias("risk")), ["rival", "risk"], "left_semi").select("company", "rival", "risk")


# ---- retrieval ----

_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"""select vec_id, round(c, 6) cosine, round((1 + c) / 2, 6) score from (select e.vec_id, {_COS} c from embeddings e, (select embedding from embeddings where vec_id = 0) q) order by c desc, vec_id limit 10""")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to that of row 0, itself included."""
    rows = table(s, d, "embeddings")
    return retrieve.vector_topk(rows, "vec_id", "embedding", rows.filter("vec_id = 0").select(F.col("embedding").alias("q")), 10)


_SOUND = "len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_HITS = f"""v as (select chunkid, doc_id, embedding from nova_embeddings where {_SOUND}), u as (select chunkid, min(doc_id) doc_id, any_value(embedding) embedding from v group by 1),
seed as (select * from u order by chunkid limit 1), scored as (select e.chunkid, e.doc_id, {_COS} c from u e, seed q), top as (select * from scored order by c desc, chunkid limit 6),
hits as (select * from top where chunkid not in (select chunkid from seed) order by c desc, chunkid limit 5)"""


def _similar_chunks(s: SparkSession, d: str) -> DataFrame:
    """The five chunks most similar to the first one, with their passage."""
    sound = retrieve.sound_vectors(table(s, d, "nova_embeddings"), "embedding", 64).groupBy("chunkid").agg(F.min("doc_id").alias("doc_id"), F.min("embedding").alias("embedding"))
    seed = sound.orderBy("chunkid").limit(1).select(F.col("chunkid").alias("_seed"), F.col("embedding").alias("q"))
    hits = retrieve.vector_topk(sound, "chunkid", "embedding", seed, 6).join(F.broadcast(seed.select(F.col("_seed").alias("chunkid"))), "chunkid", "left_anti")
    return hits.orderBy(F.desc("cosine"), "chunkid").limit(5).join(sound.select("chunkid", "doc_id"), "chunkid")


@query(f"with {_HITS} select chunkid, doc_id, round(c, 6) cosine, round((1 + c) / 2, 6) score from hits")
def similar_chunks(s: SparkSession, d: str) -> DataFrame:
    """The five chunks most similar to the first sound one, the seed left out."""
    return _similar_chunks(s, d).select("chunkid", "doc_id", "cosine", "score")


@query(f"""with {_HITS} select h.chunkid, round(h.c, 6) cosine, c.name company, d.filingtype from hits h join documents d on d.doc_id = h.doc_id join companies c on c.companyid = d.companyid""")
def similar_with_company(s: SparkSession, d: str) -> DataFrame:
    """Similar chunks with the company that filed them; chunks without one drop out."""
    rows = _similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid", "filingtype"), "doc_id").join(companies(s, d).select("companyid", "name"), "companyid")
    return rows.select("chunkid", "cosine", F.col("name").alias("company"), "filingtype")


@query(f"""with {_HITS}, {_CHAIN} select h.chunkid, coalesce(p.text, '') prev_text, coalesce(n.text, '') next_text from hits h left join chain a on a.dst = h.doc_id left join documents p on p.doc_id = a.src
left join chain b on b.src = h.doc_id left join documents n on n.doc_id = b.dst""")  # fmt: skip
def similar_with_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Similar chunks with the texts before and after them."""
    return retrieve.adjacent(_similar_chunks(s, d), chunks(s, d), next_chunk(s, d), "doc_id", "text").select("chunkid", "prev_text", "next_text")


@query(f"""with {_HITS}, {_FACES}, r as (select src, list_sort(list(distinct dst)) l from faces group by 1)
select h.chunkid, d.companyid, coalesce(array_to_string(r.l[1:5], '; '), '') risks from hits h left join documents d on d.doc_id = h.doc_id left join r on r.src = d.companyid""")  # fmt: skip
def similar_with_risks(s: SparkSession, d: str) -> DataFrame:
    """Similar chunks with five risks of their company; chunks without a company stay."""
    r = faces(s, d).groupBy(F.col("src").alias("companyid")).agg(match.first_few(F.col("dst"), 5).alias("r"))
    rows = _similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid"), "doc_id", "left").join(r, "companyid", "left")
    return rows.select("chunkid", "companyid", F.coalesce(F.array_join("r", "; "), F.lit("")).alias("risks"))


@query("""select query_id, vec_id, round(c, 6) cosine, round((1 + c) / 2, 6) score from (select *, row_number() over (partition by query_id order by c desc, vec_id) r
from (select q.vec_id query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 12) c from embeddings e, embeddings q where q.vec_id % 20 = 0)) where r <= 10""")  # fmt: skip
def vectors_topk(s: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to each whose id is divisible by 20, itself included."""
    rows = table(s, d, "embeddings")
    return retrieve.vectors_topk(rows, "vec_id", "embedding", rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", 10).drop("place")


_ALL_HITS = f"""v as (select chunkid, doc_id, embedding from nova_embeddings where {_SOUND}), u as (select chunkid, min(doc_id) doc_id, any_value(embedding) embedding from v group by 1),
hits as (select seedid, chunkid, doc_id, c from (select *, row_number() over (partition by seedid order by c desc, chunkid) r from (select q.chunkid seedid, e.chunkid, e.doc_id, round({_COS}, 12) c from u e, u q
where cast(substr(q.chunkid, 3) as bigint) % 20 = 0 and e.chunkid <> q.chunkid)) where r <= 5)"""


def _all_similar_chunks(s: SparkSession, d: str) -> DataFrame:
    """The five chunks most similar to each whose number is divisible by 20, with their passage."""
    sound = retrieve.sound_vectors(table(s, d, "nova_embeddings"), "embedding", 64).groupBy("chunkid").agg(F.min("doc_id").alias("doc_id"), F.min("embedding").alias("embedding"))
    seeds = sound.filter(F.substring("chunkid", 3, 20).cast("bigint") % 20 == 0).select(F.col("chunkid").alias("seedid"), F.col("embedding").alias("q"))
    hits = retrieve.vectors_topk(sound, "chunkid", "embedding", seeds, "seedid", 6).filter("seedid <> chunkid")
    rank = Window.partitionBy("seedid").orderBy("place")
    return hits.withColumn("r", F.row_number().over(rank)).filter("r <= 5").drop("r", "place").join(sound.select("chunkid", "doc_id"), "chunkid")


@query(f"with {_ALL_HITS} select seedid, chunkid, doc_id, round(c, 6) cosine, round((1 + c) / 2, 6) score from hits")
def all_similar_chunks(s: SparkSession, d: str) -> DataFrame:
    """The five chunks most similar to each sound one whose number is divisible by 20, the seed left out."""
    return _all_similar_chunks(s, d).select("seedid", "chunkid", "doc_id", "cosine", "score")


@query(f"""with {_ALL_HITS} select h.seedid, h.chunkid, round(h.c, 6) cosine, c.name company, d.filingtype from hits h join documents d on d.doc_id = h.doc_id join companies c on c.companyid = d.companyid""")
def all_similar_with_company(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all seeds with the company that filed them; chunks without one drop out."""
    rows = _all_similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid", "filingtype"), "doc_id").join(companies(s, d).select("companyid", "name"), "companyid")
    return rows.select("seedid", "chunkid", "cosine", F.col("name").alias("company"), "filingtype")


@query(f"""with {_ALL_HITS}, {_CHAIN} select h.seedid, h.chunkid, coalesce(p.text, '') prev_text, coalesce(n.text, '') next_text from hits h left join chain a on a.dst = h.doc_id left join documents p on p.doc_id = a.src
left join chain b on b.src = h.doc_id left join documents n on n.doc_id = b.dst""")  # fmt: skip
def all_similar_with_neighbours(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all seeds with the texts before and after them."""
    return retrieve.adjacent(_all_similar_chunks(s, d), chunks(s, d), next_chunk(s, d), "doc_id", "text").select("seedid", "chunkid", "prev_text", "next_text")


@query(f"""with {_ALL_HITS}, {_FACES}, r as (select src, list_sort(list(distinct dst)) l from faces group by 1)
select h.seedid, h.chunkid, d.companyid, coalesce(array_to_string(r.l[1:5], '; '), '') risks from hits h left join documents d on d.doc_id = h.doc_id left join r on r.src = d.companyid""")  # fmt: skip
def all_similar_with_risks(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all seeds with five risks of their company; chunks without a company stay."""
    r = faces(s, d).groupBy(F.col("src").alias("companyid")).agg(match.first_few(F.col("dst"), 5).alias("r"))
    rows = _all_similar_chunks(s, d).join(chunks(s, d).select("doc_id", "companyid"), "doc_id", "left").join(r, "companyid", "left")
    return rows.select("seedid", "chunkid", "companyid", F.coalesce(F.array_join("r", "; "), F.lit("")).alias("risks"))


_BM25 = """w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') l from documents where text is not null),
t as (select count(*) docs, avg(len(l)) avg_len from w), f as (select doc_id, len(l) len, x.q term, len(list_filter(l, lambda y: y = x.q)) tf from w, (values ('currency'), ('suppliers')) x(q) where list_contains(l, x.q)),
g as (select term, count(*) df from f group by 1), bm as (select f.doc_id, sum(ln(1 + (t.docs - g.df + 0.5) / (g.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.len / t.avg_len))) score from f join g on g.term = f.term, t group by 1)"""


@query(f"with {_BM25} select doc_id, round(score, 4) score from bm")
def bm25_terms(s: SparkSession, d: str) -> DataFrame:
    """BM25 scores of all passages with one of two words."""
    return fulltext.bm25(table(s, d, "documents"), "doc_id", "text", ["currency", "suppliers"]).select("doc_id", F.round("score", 4).alias("score"))


@query("select doc_id from (select doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') l from documents) where list_contains(l, 'currency') and list_contains(l, 'suppliers')")
def fulltext_and(s: SparkSession, d: str) -> DataFrame:
    """Passages with both words."""
    return fulltext.boolean(table(s, d, "documents"), "doc_id", "text", must=["currency", "suppliers"])


@query("select doc_id from (select doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') l from documents) where list_contains(l, 'currency') and not list_contains(l, 'suppliers')")
def fulltext_not(s: SparkSession, d: str) -> DataFrame:
    """Passages with one word and without the other."""
    return fulltext.boolean(table(s, d, "documents"), "doc_id", "text", must=["currency"], must_not=["suppliers"])


@query("""select term, levenshtein(term, 'currency') edits, count(*) n from (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) term from documents)
where regexp_full_match(term, '[a-z0-9]+') and levenshtein(term, 'currency') <= 2 group by 1""")  # fmt: skip
def fuzzy_terms(s: SparkSession, d: str) -> DataFrame:
    """Words within two edits of a term, with the number of passages that have them."""
    near = fulltext.near_terms(table(s, d, "documents"), "doc_id", "text", "currency").filter(F.col("term").rlike("^[a-z0-9]+$"))  # the SQL counts bytes, not letters
    return near.withColumn("edits", F.col("edits").cast("bigint"))


@query("""select label, count(*) hits from (select 'Company' label, name from companies union all select 'Product', name from products union all select 'Executive', name from executives)
where list_contains(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), 'united') or list_contains(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), 'anvil') group by 1""")  # fmt: skip
def entity_search(s: SparkSession, d: str) -> DataFrame:
    """Entities by words of their names, over several labels, counted per label."""
    rows = companies(s, d).select(F.lit("Company").alias("label"), "name")
    for label, t in (("Product", "products"), ("Executive", "executives")):
        rows = rows.unionByName(table(s, d, t).select(F.lit(label).alias("label"), "name"))
    return fulltext.boolean(rows, "label", "name", any_of=["united", "anvil"]).groupBy("label").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""with {_BM25}, top as (select doc_id, score from bm order by round(score, 6) desc, doc_id limit 10)
select t.doc_id, d.companyid, (select count(*) from products p where p.companyid = d.companyid) products from top t join documents d on d.doc_id = t.doc_id where d.companyid is not null""")  # fmt: skip
def search_with_products(s: SparkSession, d: str) -> DataFrame:
    """The ten best passages of a keyword search with the number of products of their company."""
    hits = fulltext.bm25(table(s, d, "documents"), "doc_id", "text", ["currency", "suppliers"]).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(10)
    rows = hits.join(chunks(s, d).select("doc_id", "companyid"), "doc_id").filter("companyid is not null")
    return match.optional_count(rows, "companyid", offers(s, d), "products").select("doc_id", "companyid", "products")


@query(f"""with {_BM25}, q as (select embedding from embeddings where vec_id = 0), vec as (select e.vec_id doc_id, (1 + {_COS}) / 2 score from embeddings e, q), v10 as (select * from vec order by score desc, doc_id limit 10), k10 as (select * from bm order by round(score, 6) desc, doc_id limit 10),
b as (select doc_id, score / (select max(score) from v10) score from v10 union all select doc_id, score / (select max(score) from k10) from k10)
select doc_id, round(max(score), 4) score from b group by 1 order by max(score) desc, doc_id limit 10""")  # fmt: skip
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Vector and keyword hits fused by their best scaled score."""
    rows = table(s, d, "embeddings")
    near = retrieve.vector_topk(rows, "vec_id", "embedding", rows.filter("vec_id = 0").select(F.col("embedding").alias("q")), 10)
    near = near.select(F.col("vec_id").alias("doc_id"), ((F.col("cosine") + 1) / 2).alias("score"))
    words = fulltext.bm25(table(s, d, "documents"), "doc_id", "text", ["currency", "suppliers"]).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(10)
    return fulltext.hybrid(near, words, "doc_id", 10).select("doc_id", F.round("score", 4).alias("score"))


# ---- texts ----


@query("""select doc_id, cast(i as integer) as index, substr(text, cast(i * 450 + 1 as bigint), 500) chunk from documents, lateral (select unnest(range(0, greatest(length(text) - 51, 0) // 450 + 1)) i) where text is not null""")
def split_chunks(s: SparkSession, d: str) -> DataFrame:
    """Texts in windows of 500 characters that overlap by 50."""
    return text.split_text(table(s, d, "documents"), "doc_id", "text")


@query(f"with {_CHAIN} select src, dst from chain")
def chunk_links(s: SparkSession, d: str) -> DataFrame:
    """The chain of the chunks of each document."""
    return next_chunk(s, d)


# ---- mutation ----


@query("""with n as (select companyid, arg_max(name, executiveid) as name from executives where companyid is not null group by 1)
select coalesce(c.companyid, n.companyid) companyid, case when n.companyid is not null then n.name else c.name end as name, c.ticker from companies c full join n on n.companyid = c.companyid""")  # fmt: skip
def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    """Upsert by key: the last row of a key wins, others keep what they have."""
    rows = table(s, d, "executives").filter("name is not null").select("companyid", "name", "executiveid")
    return mutate.merge_nodes(companies(s, d).select("companyid", "name", "ticker"), rows.select("companyid", "name", "executiveid"), "companyid", F.col("executiveid")).select("companyid", "name", "ticker")


@query("""select companyid, name from companies union all select null, t.name from (select distinct targetcompanyname as name from company_competitors where targetcompanyname is not null) t where t.name not in (select name from companies)""")
def merge_stubs(s: SparkSession, d: str) -> DataFrame:
    """Companies and one stub for every competitor name that none of them has."""
    names = table(s, d, "company_competitors").select(F.col("targetcompanyname").alias("name"))
    return mutate.merge_stubs(companies(s, d).select("companyid", "name"), names)


@query(f"with {_COMPETES} select src, dst from competes")
def merge_competitors(s: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends exist, once each."""
    return competes(s, d)


@query(f"with {_OWNS} select distinct src, dst, shares from owns")
def edge_merge_property_key(s: SparkSession, d: str) -> DataFrame:
    """Holdings with the shares as part of the key: different shares are different edges."""
    return owns(s, d).select("src", "dst", "shares").distinct()


@query(f"with {_OWNS} select src, dst, max_by(shares, (received_at, source, shares)) shares from owns where shares is not null group by 1, 2")
def edge_merge_last_wins(s: SparkSession, d: str) -> DataFrame:
    """Holdings with one edge per pair, its shares from the last row received."""
    rows = owns(s, d).filter("shares is not null").select("src", "dst", "shares", "received_at", "source")
    return mutate.merge_edges_last(rows, F.struct("received_at", "source", "shares")).select("src", "dst", "shares")


@query(f"with {_COMPETES}, gone as (select companyid from companies where name like '%Insurance%') select src, dst from competes where src not in (from gone) and dst not in (from gone)")
def detach_delete(s: SparkSession, d: str) -> DataFrame:
    """Competitor edges after some companies are deleted with their edges."""
    graph = Graph({"Company": companies(s, d)}, {"COMPETES_WITH": competes(s, d)})
    return mutate.detach_delete(graph, "Company", companies(s, d).filter(F.col("name").contains("Insurance")).select("companyid")).edges["COMPETES_WITH"]


@query("""with g as (select name, min(executiveid) survivor from executives where name is not null group by 1), m as (select e.executiveid id, g.survivor from executives e join g on g.name = e.name where e.executiveid <> g.survivor),
o as (select m.survivor, arg_min(e.title, e.executiveid) filter (where e.title <> '') title from m join executives e on e.executiveid = m.id group by 1)
select e.executiveid, e.name, coalesce(nullif(e.title, ''), o.title, e.title) title from executives e left join o on o.survivor = e.executiveid where e.executiveid not in (select id from m)""")  # fmt: skip
def fuse_nodes(s: SparkSession, d: str) -> DataFrame:
    """Executives of one name fused: the first survives and its empty title is filled from the others in order."""
    rows = table(s, d, "executives").select("executiveid", "name", "title")
    first = rows.filter("name is not null").groupBy("name").agg(F.min("executiveid").alias("survivor"))
    merges = rows.join(first, "name").filter("executiveid <> survivor").select(F.col("executiveid").alias("id"), "survivor")
    return mutate.fuse_nodes(rows, "executiveid", merges, F.col("executiveid"))


@query("select name, array_to_string(list_sort(list(distinct title)), ' | ') title, array_to_string(list_sort(list(distinct companyid)), ' | ') companyid from executives where name is not null group by 1")
def combine_by_name(s: SparkSession, d: str) -> DataFrame:
    """Executives of one name combined, conflicting values side by side."""
    return mutate.combine_by_name(table(s, d, "executives"), "name", ["title", "companyid"])


@query("""with d as (select distinct d.documentid, case when c.companyid < 'C200' then c.name end as name, case when c.companyid >= 'C100' then c.cik end cik from documents d join companies c on c.companyid = d.companyid where d.documentid is not null),
n as (select c.companyid, d.documentid from d join companies c on c.name = d.name), k as (select c.companyid, d.documentid from d join companies c on c.cik = d.cik)
select distinct companyid, documentid, 'name' how from n union all select distinct companyid, documentid, 'cik' from k where (companyid, documentid) not in (select (companyid, documentid) from n)""")  # fmt: skip
def filed_links(s: SparkSession, d: str) -> DataFrame:
    """Documents linked to companies by name first, then by CIK; of three parts of the filers one has its name noted, one its CIK, one both."""
    known = companies(s, d).select(F.col("companyid").alias("companyId"), "name", "cik")
    docs = chunks(s, d).filter("documentid is not null").join(companies(s, d), "companyid")
    docs = docs.select(F.col("documentid").alias("documentId"), F.when(F.col("companyid") < "C200", F.col("name")).alias("name"), F.when(F.col("companyid") >= "C100", F.col("cik")).alias("cik")).distinct()
    return mutate.filed_links(known, docs).select(F.col("companyId").alias("companyid"), F.col("documentId").alias("documentid"), "how")


@query("select 'P' || lpad(cast(row_number() over (order by name, productid) as varchar), cast(greatest(3, length(cast(row_number() over (order by name, productid) as varchar))) as integer), '0') id, productid from products where name is not null")
def surrogate_ids(s: SparkSession, d: str) -> DataFrame:
    """Products numbered by name without one task seeing them all."""
    from filigraph.sources.files import with_surrogate_ids

    rows = table(s, d, "products").filter("name is not null").select("productid", "name")
    return with_surrogate_ids(rows, ["name", "productid"], "P", "id").select("id", "productid")


@query("""select a.name company, coalesce(b.companyid, '') target_id, k.targetcompanyname target from company_competitors k join companies a on a.companyid = k.sourcecompanyid left join companies b on b.name = k.targetcompanyname""")
def competitor_export(s: SparkSession, d: str) -> DataFrame:
    """Competitors by name with the id of the target, ``''`` where no company has the name."""
    rows = table(s, d, "company_competitors").select(F.col("sourcecompanyid").alias("companyid"), F.col("targetcompanyname").alias("target"))
    known = companies(s, d).select(F.col("companyid").alias("target_id"), F.col("name").alias("target"))
    return rows.join(companies(s, d).select("companyid", F.col("name").alias("company")), "companyid").join(known, "target", "left").select("company", F.coalesce("target_id", F.lit("")).alias("target_id"), "target")


# ---- entity resolution ----


def _latest(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "snapshot_entities")
    last = rows.groupBy("element_id").agg(F.max_by(F.struct("label", "name", "properties", "relationship_count"), "exported_at").alias("r")).select("element_id", "r.*")
    return last.withColumn("filled", resolve.truthy_count(F.col("properties")))


_LATEST = """latest as (select element_id, r.label, r.name, coalesce(len(list_filter(map_entries(r.properties), lambda e: not starts_with(e.key, '__') and e.value is not null and e.value <> '')), 0) filled, r.relationship_count
from (select element_id, arg_max({'label': label, 'name': name, 'properties': properties, 'relationship_count': relationship_count}, exported_at) r from snapshot_entities group by 1))"""


@query(f"""with {_LATEST} select label, coalesce(name, '') as name, arg_min(element_id, {{'p': -filled, 'r': -coalesce(relationship_count, 0), 'i': element_id}}) survivor_id, count(*) members from latest group by 1, 2 having count(*) > 1""")
def exact_dedup_survivor(s: SparkSession, d: str) -> DataFrame:
    """Groups of equal label and name with the survivor."""
    return resolve.exact_duplicates(_latest(s, d))


@query("""with n as (select min(executiveid) id, lower(trim(name)) n from executives where trim(name) <> '' group by name)
select a.id a, b.id b, round(length(a.n) / length(b.n), 6) score from n a join n b on a.id <> b.id and starts_with(b.n, a.n) and (length(a.n) < length(b.n) or a.id < b.id) and length(a.n) / length(b.n) >= 0.6 - 1e-9""")  # fmt: skip
def prefix_pairs(s: SparkSession, d: str) -> DataFrame:
    """Executives whose names begin with each other; equal names are one already."""
    once = table(s, d, "executives").filter("name is not null").groupBy("name").agg(F.min("executiveid").alias("id"))
    return resolve.prefix_pairs(once, "id", "name", 0.6)


@query(r"""with n as (select min(executiveid) id, lower(list_last(regexp_split_to_array(trim(name), '\s+'))) l, regexp_matches(trim(name), '^(?i)(Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Prof\.?|Sir|Dame)\s+') t from executives where trim(name) <> '' group by name)
select a.id a, b.id b, cast(0.7 as double) score from n a join n b on a.l = b.l and a.t and not b.t""")  # fmt: skip
def honorific_pairs(s: SparkSession, d: str) -> DataFrame:
    """Executives of equal last word of which one has an honorific; equal names are one already."""
    once = table(s, d, "executives").filter("name is not null").groupBy("name").agg(F.min("executiveid").alias("id"))
    return resolve.honorific_pairs(once, "id", "name")


@query()
def fuzzy_pairs(s: SparkSession, d: str) -> DataFrame:
    """Executives whose names are alike, scored; compared with a plain double loop in the tests."""
    once = table(s, d, "executives").filter("name is not null").groupBy("name").agg(F.min("executiveid").alias("id"))
    return resolve.fuzzy_pairs(once, "id", "name", 0.85)


@query()
def honorific_stages(s: SparkSession, d: str) -> DataFrame:
    """Executives whose names are alike as they stand, without honorifics, or by their last word; compared with a double loop in the tests."""
    once = table(s, d, "executives").filter("name is not null").groupBy("name").agg(F.min("executiveid").alias("id"))
    return resolve.honorific_stages(once, "id", "name", 0.85)


_SURE = "sure as (select distinct least(entity_a_element_id, entity_b_element_id) a, greatest(entity_a_element_id, entity_b_element_id) b from merge_decisions where decision = 'merge' and confidence >= 0.8 and not isnan(confidence) and confidence <= 1 and entity_a_element_id <> entity_b_element_id)"
_REACH = f"""{_SURE}, e as (select a, b from sure union select b, a from sure), reach(id, other) as (select a, b from e union select r.id, e.b from reach r join e on e.a = r.other), comp as (select id, least(id, min(other)) component from reach group by id)"""


def _sure(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "merge_decisions").filter("decision = 'merge' and confidence >= 0.8 and not isnan(confidence) and confidence <= 1")
    a, b = "entity_a_element_id", "entity_b_element_id"
    return rows.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


@query(f"with recursive {_REACH} select id, component from comp")
def confirmed_components(s: SparkSession, d: str) -> DataFrame:
    """Components of the pairs that were confirmed with enough confidence."""
    return resolve.component_labels(_sure(s, d), "a", "b")


@query(f"""with recursive {_REACH}, n as (select component, count(*) size from comp group by 1), l as (select component, count(*) links from sure join comp on id = a group by 1)
select n.component, size, links, case when size > 10 then 'flagged' when links < size * (size - 1) / 2 then 'needs_confirmation' else 'ready' end status from n join l on l.component = n.component""")  # fmt: skip
def gated_groups(s: SparkSession, d: str) -> DataFrame:
    """Groups of confirmed pairs: ready, in need of confirmation, or flagged as too large."""
    sure = _sure(s, d)
    return resolve.gated_groups(sure, resolve.component_labels(sure, "a", "b"))


@query("select metricid, name, value, period from financial_metrics where coalesce(regexp_matches(value, '[0-9]'), false)")
def validated_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics that validation keeps: those whose value says a number."""
    return table(s, d, "financial_metrics").filter(X.is_number_like(F.col("value"))).select("metricid", "name", "value", "period")


@query(r"""select metricid, period as before, regexp_replace(trim(regexp_replace(period, '[ \t\r\n]+', ' ', 'g')), '^FY\s?(\d{4})$', 'fiscal year \1') as after from financial_metrics
where period is not null and period <> regexp_replace(trim(regexp_replace(period, '[ \t\r\n]+', ' ', 'g')), '^FY\s?(\d{4})$', 'fiscal year \1')""")  # fmt: skip
def normalized_periods(s: SparkSession, d: str) -> DataFrame:
    """The log of a normalisation: periods that change, before and after."""
    after = F.regexp_replace(X.collapsed(F.col("period")), r"^FY\s?(\d{4})$", "fiscal year $1")
    return table(s, d, "financial_metrics").select("metricid", F.col("period").alias("before"), after.alias("after")).filter(F.col("before") != F.col("after"))


@query(f"""with {_LATEST} select element_id, label from latest where filled >= 3 and coalesce(relationship_count, 0) > 10""")
def snapshot_rich_entities(s: SparkSession, d: str) -> DataFrame:
    """Latest exports with at least three properties and more than ten relationships."""
    return _latest(s, d).filter("filled >= 3 and coalesce(relationship_count, 0) > 10").select("element_id", "label")


# ---- quality ----


@query("select label, name, count(*) n from snapshot_entities group by 1, 2 having count(*) > 1")
def duplicate_entities(s: SparkSession, d: str) -> DataFrame:
    """Label and name combinations that several rows have."""
    return checks.duplicates(table(s, d, "snapshot_entities"), ["label", "name"])


@query("""select 'name' as column, count(*) as rows, count(*) filter (where name <> '') filled from products union all select 'description', count(*), count(*) filter (where description <> '') from products
union all select 'companyid', count(*), count(*) filter (where companyid <> '') from products""")  # fmt: skip
def property_completeness(s: SparkSession, d: str) -> DataFrame:
    """How many products have each property."""
    return checks.completeness(table(s, d, "products"), ["name", "description", "companyid"])


@query("select coalesce(len(embedding), -1) dimensions, count(*) as rows from nova_embeddings group by 1")
def embedding_dimensions(s: SparkSession, d: str) -> DataFrame:
    """Lengths of the vectors."""
    return checks.dimension_counts(table(s, d, "nova_embeddings"), "embedding").select(F.col("dimensions").cast("bigint").alias("dimensions"), "rows")


@query("""with d as (select documentid, chunkindex from documents where lang = 'en')
select documentid, count(*) chunks, min(chunkindex) as first, max(chunkindex) as last from d group by 1 having min(chunkindex) <> 0 or max(chunkindex) <> count(*) - 1 or count(distinct chunkindex) <> count(*)""")  # fmt: skip
def chunk_gaps(s: SparkSession, d: str) -> DataFrame:
    """Documents whose chunk indexes have gaps or repeats once passages in other languages than English are left out."""
    return checks.chunk_gaps(table(s, d, "documents").filter("lang = 'en'"), "documentid", "chunkindex")


@query(f"""with {_FACES}, {_OWNS}, {_COMPETES}, t as (select companyid id from products union select companyid from executives union select companyid from financial_metrics union select src from competes union select dst from competes
union select dst from owns union select src from faces union select companyid from documents where documentid is not null)
select count(*) nodes, count(*) filter (where companyid not in (select id from t where id is not null)) orphans from companies""")  # fmt: skip
def company_orphans(s: SparkSession, d: str) -> DataFrame:
    """Companies and how many of them no edge touches."""
    return checks.orphans(filings_graph(s, d)).filter("label = 'Company'").select("nodes", "orphans")


@query(f"""with {_FACES}, {_OWNS}, {_COMPETES}, {_CHAIN}, {_FILED},
n as (select companyid id, 'Company' l from companies union all select productid, 'Product' from products union all select executiveid, 'Executive' from executives union all select metricid, 'FinancialMetric' from financial_metrics
union all select distinct dst, 'RiskFactor' from faces union all select distinct managercik, 'AssetManager' from asset_manager_holdings where managercik is not null union all select distinct documentid, 'Document' from documents where documentid is not null
union all select cast(doc_id as varchar), 'Chunk' from documents),
e as (select companyid src, productid dst, 'OFFERS' as type from products where companyid is not null union all select companyid, executiveid, 'HAS_EXECUTIVE' from executives where companyid is not null
union all select companyid, metricid, 'REPORTS' from financial_metrics where companyid is not null union all select src, dst, 'COMPETES_WITH' from competes union all select distinct src, dst, 'OWNS' from owns
union all select src, dst, 'FACES_RISK' from faces union all select src, dst, 'FILED' from filed union all select cast(doc_id as varchar), documentid, 'FROM_DOCUMENT' from documents where documentid is not null
union all select cast(src as varchar), cast(dst as varchar), 'NEXT_CHUNK' from chain union all select sourcecompanyid, targetcompanyid, 'PARTNERS_WITH' from company_competitors where targetcompanyid <> ''),
ok as (select * from (values ('OFFERS', 'Company', 'Product'), ('HAS_EXECUTIVE', 'Company', 'Executive'), ('REPORTS', 'Company', 'FinancialMetric'), ('COMPETES_WITH', 'Company', 'Company'), ('OWNS', 'AssetManager', 'Company'), ('FACES_RISK', 'Company', 'RiskFactor'),
('FILED', 'Company', 'Document'), ('FROM_DOCUMENT', 'Chunk', 'Document'), ('NEXT_CHUNK', 'Chunk', 'Chunk'), ('PARTNERS_WITH', 'Company', 'Company')) t(type, a, b))
select e.type, x.l src_label, y.l dst_label, count(*) edges from e left join n x on x.id = e.src left join n y on y.id = e.dst where not exists (select 1 from ok where ok.type = e.type and ok.a = x.l and ok.b = y.l) group by 1, 2, 3""")  # fmt: skip
def schema_violations(s: SparkSession, d: str) -> DataFrame:
    """Edges of the whole graph whose ends the schema does not allow; competitor rows as typed stand in for partners, whose ends nobody has checked."""
    typed = table(s, d, "company_competitors").filter("targetcompanyid <> ''").select(F.col("sourcecompanyid").alias("src"), F.col("targetcompanyid").alias("dst"))
    return checks.wrong_ends(filings_graph(s, d).with_edges("PARTNERS_WITH", typed))


# ---- star tables as a graph ----


@query("""with o as (select o.o_custkey src, l.l_suppkey dst, cast(sum(l.l_quantity) as bigint) shares from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1, 2)
select src manager, count(*) holdings, cast(sum(shares) as bigint) total_shares from o group by 1""")  # fmt: skip
def star_holdings(s: SparkSession, d: str) -> DataFrame:
    """Customers as managers, suppliers as companies: holdings and shares per manager."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    edges = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("shares"))
    return edges.groupBy(F.col("src").alias("manager")).agg(F.count(F.lit(1)).alias("holdings"), F.sum("shares").alias("total_shares"))


@query("""with f as (select distinct l.l_suppkey src, p.p_name dst from lineitem l join part p on p.p_partkey = l.l_partkey) select dst risk, count(*) cnt, string_agg(s.s_name, ',' order by s.s_name) companies
from f join supplier s on s.s_suppkey = f.src group by 1 having count(*) > 1""")  # fmt: skip
def star_shared_names(s: SparkSession, d: str) -> DataFrame:
    """Part names that several suppliers ship, with the suppliers."""
    parts = table(s, d, "part").select("p_partkey", F.col("p_name").alias("risk"))
    pairs = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "risk").distinct()
    named = pairs.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return named.groupBy("risk").agg(F.count(F.lit(1)).alias("cnt"), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("companies")).filter("cnt > 1")


@query("select n.n_name, r.r_name, count(s.s_suppkey) suppliers from nation n join region r on r.r_regionkey = n.n_regionkey left join supplier s on s.s_nationkey = n.n_nationkey group by 1, 2")
def star_optional_hop(s: SparkSession, d: str) -> DataFrame:
    """Nations with their region and the number of their suppliers, zero included."""
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = table(s, d, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    return match.optional_count(nations, "n_nationkey", edges, "suppliers").select("n_name", "r_name", "suppliers")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def star_anti_pattern(s: SparkSession, d: str) -> DataFrame:
    """Orders without a line."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"))
    return match.lacking(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", lines)


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) k, count(*) n from events group by 1, 2")
def star_json_property(s: SparkSession, d: str) -> DataFrame:
    """Events by type and by a property inside JSON."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(s, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events""")
def star_event_chain(s: SparkSession, d: str) -> DataFrame:
    """Each event with the type of the one before it of the same user."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").select("user_id", "event_id", "event_type", before.alias("before"))
