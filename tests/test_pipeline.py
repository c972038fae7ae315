"""Pipeline, read-only SQL, look-ups and the streamed upsert."""

import pytest
from pyspark.sql import functions as F

from filigraph.graph import Graph
from filigraph.operators import checks
from filigraph.operators import pipeline as P
from filigraph.streaming.upserts import newest, upsert_stream


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_embedding(spark):
    chunks = spark.createDataFrame([(1, "cash flow", None), (2, "x", [1.0]), (3, None, None)], "id int, t string, v array<float>")
    got = {r.id: r.v for r in P.embed_missing(chunks, "t", "v").collect()}
    assert len(got[1]) == 64 and got[2] == [1.0] and got[3] is None
    put = P.upsert_vectors(chunks, spark.createDataFrame([(3, [2.0])], "id int, v array<float>"), "id", "v")
    assert {r.id: r.v for r in put.collect()}[3] == [2.0]
    ready = P.embed_missing(chunks.filter("t is not null").withColumn("v", F.lit(None).cast("array<float>")), "t", "v")
    assert P.search(ready, "id", "t", "v", "cash", 1).first().id == 1
    assert "extra" in P.search(ready, "id", "t", "v", "cash", 1, enrich=lambda h: h.withColumn("extra", F.lit(1))).columns


def test_extraction_and_metadata(spark):
    chunks = spark.createDataFrame([(1, "Acme Corp sells Pump X.")], "id int, t string")
    dictionary = lambda *rows: spark.createDataFrame(rows, "id string, name string")
    assert pairs(P.extracted(chunks, "id", "t", {"Company": dictionary(("c", "Acme Corp")), "Product": dictionary(("p", "Pump X"), ("q", "Valve"))})) == [("Company", "c", 1), ("Product", "p", 1)]
    meta = spark.createDataFrame([("f.pdf", "APPLE INC", "AAPL", "1", "2")], "file string, name string, ticker string, cik string, cusip string")
    got = P.with_company(spark.createDataFrame([("a/f.pdf",), ("g.pdf",)], "path string"), meta, "path")
    assert {r.path: r.company for r in got.collect()} == {"a/f.pdf": "Apple Inc.", "g.pdf": None}


def test_resolution(spark):
    rows = [("1", "Acme Corp", "AC", None), ("2", "Acme Corporation", "AC", None), ("3", "Acme Corp.", "AC", None), ("4", "Acme Mobile", "AM", None), ("5", "Acme Corp", "AC", None), ("6", None, None, None)]
    entities = spark.createDataFrame(rows, "element_id string, name string, ticker string, cik string")
    groups = P.resolve_entities(entities, P.ResolutionConfig("fuzzy", 0.6))
    assert {r.element_id for r in groups.collect()} == {"1", "2", "3", "5"}
    assert pairs(P.run_summary(groups).select("status", "entities")) == [("ready", 4)]
    assert pairs(P.merge_map(groups)) == [("2", "1"), ("3", "1"), ("5", "1")]
    assert P.resolve_entities(entities, P.ResolutionConfig("prefix", 0.3)).count() == 4


def test_resolution_of_copies(spark):
    rows = [("1", "Solo Ltd", None, 1, 0), ("2", "Solo Ltd", None, 3, 0), ("3", "Solo Ltd", None, 3, 9), ("4", None, None, 0, 0), ("5", "", None, 0, 1), ("6", "Only One", None, 5, 5),
            ("a", "Acme Corp", "AC", 0, 0), ("b", "Acme Corp", "AC", 2, 0), ("c", "Acme Corporation", "AC", 1, 7), ("x", "Beta Holdings", "B", 0, 0), ("y", "Beta Holding", "B", 0, 0), ("z", "Beta Holding", "B", 1, 0)]
    entities = spark.createDataFrame([(*r[:3], None, *r[3:]) for r in rows], "element_id string, name string, ticker string, cik string, filled int, relationship_count bigint")
    groups = P.resolve_entities(entities, P.ResolutionConfig("fuzzy", 0.6)).cache()
    assert pairs(P.merge_map(groups)) == [("1", "3"), ("2", "3"), ("4", "5"), ("a", "b"), ("c", "b"), ("x", "z"), ("y", "z")]
    nodes = entities.select(F.col("element_id").alias("id"), F.col("name"), F.when(F.col("element_id") != "3", F.lit("7")).otherwise("none").alias("value"))
    plan = P.cleanse_plan(nodes, "id", "name", "value", groups)
    assert pairs(plan.removals) == [("3",)] and [m for m in pairs(plan.merges) if m[0] < "4"] == [("1", "2")]
    gated = P.resolve_entities(entities, P.ResolutionConfig("fuzzy", 0.6, max_group=1)).cache()
    assert pairs(P.merge_map(gated)) == [("1", "3"), ("2", "3"), ("4", "5"), ("a", "b"), ("y", "z")]
    assert pairs(gated.filter("status = 'flagged'").select("component", "element_id")) == [("b", "b"), ("b", "c"), ("x", "x"), ("x", "z")]


def test_cleanse(spark):
    nodes = spark.createDataFrame([("a", "m", " 5  x "), ("b", "m", "none"), ("c", "m", ""), ("d", "m", "7")], "id string, name string, value string")
    graph = Graph({"FinancialMetric": nodes}, {"REPORTS": spark.createDataFrame([("co", "a"), ("co", "b"), ("co", "d")], "src string, dst string")})
    groups = spark.createDataFrame([("a", "a", "m", "ready"), ("a", "d", "m", "ready")], "component string, element_id string, name string, status string")
    plan = P.cleanse_plan(nodes, "id", "name", "value", groups)
    assert pairs(plan.removals) == [("b",), ("c",)] and pairs(plan.merges) == [("d", "a")]
    out = P.apply_cleanse(graph, "FinancialMetric", "value", plan)
    assert pairs(out.nodes["FinancialMetric"]) == [("a", "m", "5 x")] and pairs(out.edges["REPORTS"]) == [("co", "a")]


def test_comparisons(spark):
    make = lambda *rows: spark.createDataFrame(rows, "name string, d string")
    assert pairs(P.name_differences(make(("a", "x"), ("b", "xx"), (None, "z")), make(("b", "x"), ("c", None)), "name", "d")) == [("a", "only_a", None), ("b", "both", "shorter"), ("c", "only_b", None)]
    assert pairs(P.missing_names(make(("a", "x")), "name", ["a", "b"])) == [("b",)]
    count = lambda *rows: spark.createDataFrame(rows, "k string, n bigint")
    assert pairs(P.count_differences(count(("a", 1), ("b", 2)), count(("a", 1), ("c", 3)), "k", "n")) == [("b", 2, 0), ("c", 0, 3)]


def test_read_only(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert P.safe_sql(spark, "select count(*) as n from numbers where id > :least", least=0).first().n == 2
    good = [
        "with a as (select id, id % 2 as k from numbers) select k, sum(id) as s from a group by k having sum(id) > 0 order by k limit 5", "select * from numbers n where exists (select 1 from numbers m where m.id = n.id + 1)",
        "select a.id from numbers a join numbers b on a.id = b.id union all select id from numbers where id in (select max(id) from numbers)", "select id, row_number() over (order by id) as r from numbers", "select explode(array(1, 2)) as x", "select * from values (1), (2) as t(a)",
    ]
    for text in good:
        assert P.safe_sql(spark, text).count() > 0, text
    for bad in (
        "drop table numbers", "create table t as select 1 as a", "insert into numbers select 1", "set x = 1", "truncate table numbers", "EXECUTE IMMEDIATE 'drop table if exists t'", "BEGIN drop table if exists zz; END", "BEGIN select 1; END",
        "select java_method('java.lang.System', 'getenv')", "select * from numbers where id = (select reflect('java.util.UUID', 'randomUUID'))", "with a as (select try_reflect('java.lang.Runtime', 'x') as r) select * from a",
        "select * from parquet.`/tmp`", "select 1; drop table numbers", "cache table numbers", "not sql at all", "describe numbers", "select * from python_worker_logs()",
    ):
        with pytest.raises(P.NotReadOnly):
            P.safe_sql(spark, bad)
    companies = spark.createDataFrame([("C1", "Acme", "AC", "1", "2")], "companyid string, name string, ticker string, cik string, cusip string")
    assert P.lookup(spark, "company_details", {"companies": companies}, name="Acme").count() == 1
    assert P.schema_summary(Graph({"Company": companies})).count() == 5


def test_stream(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    table.mkdir()
    schema = "id string, v string, n int"
    for i, rows in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "9", 1), ("a", "3", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        query = upsert_stream(spark.readStream.schema(schema).json(str(source)), str(table), "id", F.col("n"), str(tmp_path / "check"))
        assert query.awaitTermination(120) and query.exception() is None
    assert pairs(newest(spark, str(table)).select("id", "v")) == [("a", "3"), ("b", "1"), ("c", "9")]


def test_cleanse_keeps_properties_and_other_labels(spark):
    """Ids of one label may be those of another; edges keep what they carry."""
    graph = Graph(
        {"Company": spark.createDataFrame([("1", "A", "x"), ("2", "B", "y"), ("3", "C", "z")], "companyId string, name string, note string"), "AssetManager": spark.createDataFrame([("2", "M")], "managerId string, name string")},
        {"OWNS": spark.createDataFrame([("2", "1", 10), ("2", "2", 20), ("2", "3", 30)], "src string, dst string, shares bigint")},
    )
    make = lambda text, schema: spark.createDataFrame(text, schema)
    plan = P.CleansePlan(make([], "id string"), make([("2", "1"), ("3", "3")], "id string, survivor string"), make([("1", "w")], "id string, after string"))
    out = P.apply_cleanse(graph, "Company", "note", plan)
    assert pairs(out.edges["OWNS"]) == [("2", "1", 10), ("2", "3", 30)] and {r.companyId: r.note for r in out.nodes["Company"].collect()} == {"1": "w", "3": "z"}


def test_run_counters_and_comparison(spark):
    make = spark.createDataFrame
    candidates = make([("a", "b", 0.5), ("a", "c", 1.0)], "a string, b string, score double")
    decisions = make([("merge", 0.9), ("no_merge", None), (None, None)], "decision string, confidence double")
    groups = make([("a", "ready", "a"), ("a", "ready", "b"), ("c", "flagged", "c")], "component string, status string, element_id string")
    got = P.run_counters(9, candidates, decisions, groups, make([("b", "a")], "id string, survivor string")).first().asDict()
    assert got == {
        "entities": 9, "candidates": 2, "mean_score": 0.75, "merge_decisions": 1, "no_merge_decisions": 1, "unevaluated": 1, "mean_confidence": 0.9, "groups": 2, "ready": 1, "needs_confirmation": 0, "flagged": 1, "largest": 2, "merged": 1, "survivors": 1,
        "remaining": 8,
    }
    empty = P.run_counters(0, candidates.limit(0), decisions.limit(0), groups.limit(0), make([], "id string, survivor string")).first()
    assert empty.candidates == empty.groups == empty.largest == empty.merged == 0
    runs = make([("x", 6, 6, 3, 4, 2), ("y", 6, 6, 4, 4, 3), ("z", 5, 6, 4, 4, 1), ("w", 6, 6, 3, 4, 1)], "run string, expected_met int, expected int, forbidden_met int, forbidden int, created_at int")
    assert [r.run for r in P.compared_runs(runs).collect()] == ["y", "w", "x", "z"]


def test_merge_and_search_checks(spark):
    nodes = spark.createDataFrame([("1", "Apple"), ("2", "Apple"), ("3", "PayPal"), ("4", "PayPal (Europe)"), ("5", None)], "id string, name string")
    got = pairs(checks.merge_checks(nodes, "name", ["Apple", "PayPal", "Nobody"], [("PayPal", "PayPal (Europe)"), ("PayPal", "Nobody")]).select("kind", "name", F.coalesce("other", F.lit("")), "status"))
    assert got == [("separate", "PayPal", "Nobody", "SKIP"), ("separate", "PayPal", "PayPal (Europe)", "PASS"), ("unique", "Apple", "", "FAIL"), ("unique", "Nobody", "", "SKIP"), ("unique", "PayPal", "", "PASS")]
    hits = spark.createDataFrame([("a", "text"), ("b", " ")], "id string, answer string")
    assert pairs(checks.search_checks({"vector": hits, "none": hits.limit(0), "blank": hits.filter("id = 'b'")}, "answer")) == [("blank", 1, 0, "FAIL"), ("none", 0, 0, "FAIL"), ("vector", 2, 1, "PASS")]


def test_more_lookups(spark):
    companies = spark.createDataFrame([("C1", "Acme", "AC", "1", "2"), ("C2", "Bolt", "BO", "3", "4")], "companyid string, name string, ticker string, cik string, cusip string")
    risks = spark.createDataFrame([("fire", "x", "Acme"), ("flood", "y", "Acme"), ("fire", "z", "Bolt")], "name string, description string, company string")
    tables = {"companies": companies, "risks": risks, "owns": spark.createDataFrame([("M", "C2", 1), ("M", "C2", 2)], "src string, dst string, shares int")}
    assert pairs(P.lookup(spark, "company_risks", tables, name="Acme")) == [("fire", "x"), ("flood", "y")]
    assert pairs(P.lookup(spark, "shared_risks", tables, name="Acme", other="Bolt")) == [("fire",)]
    assert pairs(P.lookup(spark, "companies_of_manager", tables, id="M")) == [("Bolt", "BO")]
