"""Graph operators on small frames: nulls, repeats, ties and empty inputs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from filigraph.functions import expressions as X
from filigraph.graph import Graph
from filigraph.operators import checks, fulltext, match, mutate, resolve, retrieve, text
from filigraph.operators import pipeline as P
from filigraph.sources import files


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def graph(spark):
    people = spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("c", None)], "id string, name string")
    knows = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "b")], "src string, dst string")
    return Graph({"Person": people}, {"KNOWS": knows})


def test_match(spark, graph):
    people, knows = graph.nodes["Person"], graph.edges["KNOWS"]
    other = people.select(F.col("id").alias("other"), F.col("name").alias("friend"))
    assert pairs(match.hop(people, "id", knows.distinct(), other, "other").select("id", "friend")) == [("a", "Ann"), ("a", "Bob"), ("b", "Ann")]
    assert pairs(match.optional_count(people, "id", knows, "n").select("id", "n")) == [("a", 2), ("b", 1), ("c", 0)]
    assert pairs(match.having(people, "id", knows).select("id")) == [("a",), ("b",)]
    assert pairs(match.lacking(people, "id", knows).select("id")) == [("c",)]
    assert pairs(match.degrees(knows)) == [("a", 4), ("b", 3)]
    back = knows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert all(r.mutual for r in match.flagged(knows, ("src", "dst"), back, "mutual").collect())


def test_views(graph):
    assert pairs(graph.label_counts()) == [("Person", 3)]
    assert pairs(graph.edge_counts()) == [("KNOWS", 4)]
    assert {r.id: r.props for r in graph.all_nodes().collect()}["c"] == {}


def test_merge_nodes(spark, graph):
    rows = spark.createDataFrame([("a", "Anna", 1), ("a", None, 3), ("d", "Dan", 1), (None, "x", 9), ("a", "Ana", 2)], "id string, name string, n int")
    got = pairs(mutate.merge_nodes(graph.nodes["Person"], rows.select("id", "name", "n"), "id", F.col("n")).select("id", F.coalesce("name", F.lit("-"))))
    assert got == [("a", "-"), ("b", "Bob"), ("c", "-"), ("d", "Dan")]


def test_three_upserts_leave_one_row(spark):
    base = spark.createDataFrame([("Apple Inc.", 0)], "name string, chunk int")
    for i in (1, 2, 3):
        base = mutate.merge_nodes(base, spark.createDataFrame([("Apple Inc.", i)], "name string, chunk int"), "name", F.lit(1))
    assert pairs(base.select("name", "chunk")) == [("Apple Inc.", 3)]


def test_stubs_and_edges(spark, graph):
    people = graph.nodes["Person"]
    names = spark.createDataFrame([("Bob",), ("Eve",), ("Eve",), (None,)], "name string")
    assert mutate.merge_stubs(people, names).count() == 4
    rows = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "z", 1), (None, "b", 1)], "src string, dst string, shares int")
    assert mutate.merge_edges(rows, people, "id", people, "id").count() == 1
    assert mutate.merge_edges(rows, people, "id", people, "id", with_properties=True).count() == 2
    assert pairs(mutate.merge_edges_last(rows.filter("src = 'a'"), F.col("shares"))) == [("a", "b", 2), ("a", "z", 1)]


def test_delete(spark, graph):
    out = mutate.detach_delete(graph, "Person", spark.createDataFrame([("b",), ("nobody",)], "id string"))
    assert pairs(out.nodes["Person"].select("id")) == [("a",), ("c",)]
    assert pairs(out.edges["KNOWS"]) == [("a", "a")]
    blank = graph.with_nodes("Person", spark.createDataFrame([("a", ""), ("b", None)], "id string, name string"))
    assert pairs(mutate.without_blank_keys(blank, "Person", "name").nodes["Person"].select("id")) == [("b",)]


def test_fusion(spark):
    nodes = spark.createDataFrame([("s", "S", ""), ("x", "X", None), ("y", "Y", "late"), ("z", "Z", "last")], "id string, name string, title string")
    chains = spark.createDataFrame([("x", "s"), ("z", "y"), ("y", "s")], "id string, survivor string")
    final = mutate.final_survivors(chains)
    assert pairs(final) == [("x", "s"), ("y", "s"), ("z", "s")]
    assert pairs(mutate.fuse_nodes(nodes, "id", final, F.col("id"))) == [("s", "S", "late")]
    edges = spark.createDataFrame([("x", "q"), ("y", "q"), ("x", "s")], "src string, dst string")
    assert pairs(mutate.redirect_edges(edges, final)) == [("s", "q"), ("s", "s")]
    rich = spark.createDataFrame([("x", "q", 1), ("y", "q", 2), ("s", "r", 3), ("x", "r", 4), ("k", "x", 5), ("k", "z", 6)], "src string, dst string, shares int")
    assert pairs(mutate.redirect_edges(rich, final)) == [("k", "s", 5), ("s", "q", 1), ("s", "r", 3)]
    assert pairs(mutate.redirect_edges(rich, final, ("dst",))) == [("k", "s", 5), ("s", "r", 3), ("x", "q", 1), ("x", "r", 4), ("y", "q", 2)]


def test_merges_in_a_circle(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, survivor string")
    assert pairs(mutate.final_survivors(make(("a", "b"), ("b", "c"), ("c", "a")))) == [("b", "a"), ("c", "a")]
    long = [(f"n{i:03}", f"n{i + 1:03}") for i in range(90)]
    assert pairs(mutate.final_survivors(make(*long))) == [(a, "n090") for a, _ in long]
    assert pairs(mutate.final_survivors(make(("t", "u"), ("u", "c"), ("c", "b"), ("b", "c"), ("x", "y")))) == [("c", "b"), ("t", "b"), ("u", "b"), ("x", "y")]
    assert pairs(mutate.final_survivors(make(("a", "a")))) == []


def test_combine_and_keys(spark):
    rows = spark.createDataFrame([("n", "b"), ("n", "a"), ("m", None), (None, "x")], "name string, v string")
    assert sorted((r.name, r.v) for r in mutate.combine_by_name(rows, "name", ["v"]).collect()) == [("m", None), ("n", "a | b")]
    assert pairs(mutate.key_violations(rows, "name")) == [("n", 2)]


def test_links(spark):
    companies = spark.createDataFrame([("c1", "A", "1"), ("c2", "B", "2")], "companyId string, name string, cik string")
    documents = spark.createDataFrame([("d1", "A", "2"), ("d2", "?", "2"), ("d3", None, None)], "documentId string, name string, cik string")
    assert pairs(mutate.filed_links(companies, documents)) == [("c1", "d1", "name"), ("c2", "d1", "cik"), ("c2", "d2", "cik")]
    link = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = mutate.provenance_links(link([("r", "k")]), link([("k", "d")]), link([("c", "d")]), link([("c", "r"), ("c", "o")]))
    assert pairs(got) == [("c", "o"), ("c", "r")]


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    assert [r.id for r in retrieve.similar_rows(rows, "id", "v", F.col("id") == 1, 2).collect()] == [2, 3]
    assert pairs(retrieve.sound_vectors(rows, "v", 2).select("id")) == [(1,), (2,), (3,)]
    chain = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    words = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id int, t string")
    got = {r.id: (r.prev_text, r.next_text) for r in retrieve.adjacent(words.select("id"), words, chain, "id", "t").collect()}
    assert got == {1: ("", "two"), 2: ("one", "three"), 3: ("two", "")}


def test_many_query_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS", 40)
    monkeypatch.setattr(retrieve, "QUERIES", 7)
    monkeypatch.setattr(retrieve, "SLICE", 3)
    vectors = {i: [float((i * i * p) % 11 - 5) for p in (1, 3, 7, 13)] for i in range(120)} | {120: [0.0] * 4, 121: [float("nan")] * 4, 122: [1.0], 123: [2.0] * 4}
    rows = spark.createDataFrame([*vectors.items(), (124, None)], "id int, v array<double>")
    queries = rows.filter("id % 4 = 0").select(F.col("id").alias("asked"), F.col("v").alias("q"))
    got = {}
    for r in retrieve.vectors_topk(rows, "id", "v", queries, "asked", 5).collect():
        got.setdefault(r.asked, {})[r.place] = (r.id, r.cosine)
    size = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / size(a) / size(b)
    sound = {i: v for i, v in vectors.items() if i not in (120, 121, 122) and any(v)}
    for i, q in sound.items():
        if i % 4 == 0:
            want = sorted(((-round(cos(q, v), 12), j) for j, v in sound.items()))[:5]
            assert [got[i][p] for p in range(1, 6)] == [(j, pytest.approx(-c, abs=1e-6)) for c, j in want]
    assert set(got) == {i for i in sound if i % 4 == 0}
    with pytest.raises(Exception, match="more than one query vector"):
        retrieve.vector_topk(rows, "id", "v", queries, 5).collect()


def test_fulltext(spark):
    rows = spark.createDataFrame([(1, "cash flow and cash"), (2, "Flow of risk"), (3, None), (4, "")], "id int, t string")
    scores = {r.id: r.score for r in fulltext.bm25(rows, "id", "t", ["cash", "flow"]).collect()}
    assert scores[1] > scores[2] > 0 and set(scores) == {1, 2}
    assert pairs(fulltext.boolean(rows, "id", "t", must=["flow"], must_not=["cash"])) == [(2,)]
    assert [r.term for r in fulltext.near_terms(rows, "id", "t", "rusk", 1).collect()] == ["risk"]
    hits = rows.filter("id < 3").select("id", F.lit(2.0).alias("score"))
    assert fulltext.hybrid(hits, hits.filter("id = 1"), "id", 5).count() == 2


def test_texts(spark):
    rows = spark.createDataFrame([(1, "x" * 1000), (2, "short"), (3, ""), (4, None)], "id int, t string")
    got = text.split_text(rows, "id", "t").collect()
    assert [len(r.chunk) for r in got if r.id == 1] == [500, 500, 100] and sum(r.id == 2 for r in got) == 1
    assert all(not r.chunk.endswith("wor") for r in text.split_text(spark.createDataFrame([(1, "word " * 300)], "id int, t string"), "id", "t", whole_words=True).collect())
    chunks = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), (None, 0, "z"), ("e", 0, "c")], "doc string, i int, id string")
    assert pairs(text.chunk_chain(chunks, "doc", "i", "id")) == [("a", "b")]
    vec = spark.createDataFrame([("Cash flow",), ("",)], "t string").select(text.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in vec[0].v) == pytest.approx(1, abs=1e-6) and not any(vec[1].v)
    names = spark.createDataFrame([("p", "Acme Corp"), ("q", "Other"), ("r", None)], "k string, n string")
    found = [(1, "we met acme corp. twice"), (2, "Acme-Corp"), (3, "acme corporate"), (4, None), (5, "corp acme"), (6, "Other")]
    assert pairs(text.mentions(spark.createDataFrame(found, "id int, t string"), "id", "t", names, "n", "k")) == [("p", 1), ("p", 2), ("q", 6)]


def test_resolution(spark):
    names = spark.createDataFrame([("1", "Microsoft"), ("2", "Microsoft Corporation"), ("3", "Apple"), ("4", None), ("5", " ")], "id string, n string")
    assert pairs(resolve.prefix_pairs(names, "id", "n", 0.3)) == [("1", "2", pytest.approx(9 / 21, abs=1e-6))]
    assert pairs(resolve.prefix_pairs(names, "id", "n", 0.5)) == []
    people = spark.createDataFrame([("1", "Mr. Smith"), ("2", "Bradford L. Smith"), ("3", "Ms. Hood"), ("4", "Amy E. Hood")], "id string, n string")
    assert pairs(resolve.honorific_pairs(people, "id", "n").select("a", "b")) == [("1", "2"), ("3", "4")]
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "z")], "a string, b string")
    labels = resolve.component_labels(edges, "a", "b")
    assert pairs(labels) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    confirmed = edges.filter("a is not null and a <> b")
    groups = resolve.gated_groups(confirmed, labels)
    assert pairs(groups) == [("a", 3, 2, "needs_confirmation"), ("x", 2, 1, "ready")]
    assert pairs(resolve.missing_pairs(confirmed, labels, groups)) == [("a", "a", "c")]
    assert pairs(resolve.gated_groups(confirmed, labels, 2).filter("component = 'a'").select("status")) == [("flagged",)]


def test_ground_truth(spark):
    found = [(i, n) for i, group in enumerate(resolve.MUST_MERGE) for n in group] + [(90, "PayPal"), (91, "PayPal (Europe)"), (92, "PayPal Pte. Ltd."), (93, "Microsoft Mobile Oy"), (94, "Microsoft's Bing")]
    groups = spark.createDataFrame(found, "component int, name string")
    got = resolve.ground_truth(groups, resolve.MUST_MERGE, resolve.MUST_NOT_MERGE).collect()
    assert len(got) == 10 and all(r.passed for r in got)
    facts = spark.createDataFrame([("a", "T", None), ("b", "T", None), ("c", "U", None), ("d", None, None)], "id string, ticker string, cik string")
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    assert {(r.a, r.b): r.same for r in resolve.verdicts(asked, facts, "id").collect()} == {("a", "b"): True, ("a", "c"): False, ("a", "d"): None}


def test_fuzzy_pairs_against_all_pairs(spark):
    names = [("1", "Microsoft Corporation"), ("2", "Microsoft Corp"), ("3", "Apple Inc."), ("4", "Apple Inc"), ("5", "Corporation of Apple")]
    got = {(r.a, r.b) for r in resolve.fuzzy_pairs(spark.createDataFrame(names, "id string, n string"), "id", "n", 0.8).collect()}
    want = {(a, b) for a, x in names for b, y in names if a < b and resolve.weighted_ratio(x, y) >= 0.8}
    assert got == want


def test_fuzzy_pairs_of_slips_and_initials(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 7)  # so that names of several blocks meet
    said = ["Samuel \"Sam\" Sagrepluomt", "Samuel U. Sagreplumot", "Priya L. Jakuuhoplon, Esq.", "Priya L. Jakuhoplon", "Dr. Edward I. Stohoddacral", "Edward Stohodacral", "Stohodacral, Edward", "Edward Edward Stohodacral",
            "Ann Lee", "Anne Lee", "Lee", "ann-lee", "Zoë Müller", "Zoe Müller", "Müller Zoë", "J. Smith", "John Smith", "Jhon Smith", "John A. Smith Jr.", "Smith", "A", "a.", "The Johnsmith Group", "Smithson"]
    names = [(f"{i:02}", n) for i, n in enumerate(said)]
    df = spark.createDataFrame(names, "id string, n string")
    for t in (0.6, 0.85, 0.95):
        want = {(a, b): round(s, 6) for a, x in names for b, y in names if a < b and (s := resolve.weighted_ratio(x, y)) >= t}
        assert {(r.a, r.b): r.score for r in resolve.fuzzy_pairs(df, "id", "n", t).collect()} == want and want


def test_honorific_stages(spark):
    said = ["Prof. Ann Lee", "Dr. Ann Lee", "Ann Lee", "Mr. Smith", "Bradford L. Smith", "Smith", "Ms. Hood", "Amy E. Hood", "Sir John Hood", "Dame Amy E. Hood", "Xavier"]
    names = [(f"{i:02}", n) for i, n in enumerate(said)]
    bare = lambda n: re.sub(resolve.HONORIFIC.replace("(?i)", ""), "", n, flags=re.I).strip()
    for t in (0.6, 0.9):
        want = {}
        for a, x in names:
            for b, y in names:
                if a < b:
                    first, second = resolve.weighted_ratio(x, y), resolve.weighted_ratio(bare(x), bare(y))
                    third = 0.7 if (bare(x) != x) != (bare(y) != y) and x.lower().split()[-1] == y.lower().split()[-1] else None
                    score = first if first >= t else second if second >= t else third
                    if score is not None:
                        want[a, b] = round(score, 6)
        got = P.STRATEGIES["honorific"](spark.createDataFrame(names, "id string, n string"), "id", "n", t)
        assert {(r.a, r.b): r.score for r in got.collect()} == want
    assert want["00", "01"] == 1.0


def test_checks(spark, graph):
    assert pairs(checks.completeness(graph.nodes["Person"], ["name"])) == [("name", 3, 2)]
    assert pairs(checks.orphans(graph)) == [("Person", 3, 1)]
    assert checks.wrong_ends(graph).count() == 1
    gaps = spark.createDataFrame([("d", 0), ("d", 2), ("e", 0), ("e", 1)], "doc string, i int")
    assert pairs(checks.chunk_gaps(gaps, "doc", "i")) == [("d", 2, 0, 2)]
    before = spark.createDataFrame([(1, "t", [1.0]), (2, "u", [2.0]), (3, "v", None)], "id int, t string, v array<double>")
    after = spark.createDataFrame([(1, "t", [1.0 + 1e-12]), (2, "x", [2.0]), (4, "v", None)], "id int, t string, v array<double>")
    assert pairs(checks.round_trip_differences(before, after, "id", "t", "v")) == [(2, "text"), (3, "lost"), (4, "added")]


def test_files(spark, graph, tmp_path):
    from filigraph.schema import LABELS

    rows = spark.createDataFrame([("C001", 'Amazon.com, "Inc."', "AMZN", "1018724", "023135106"), ("C002", None, "", "2", "3")], LABELS["Company"].schema)
    files.write_csv(rows, f"{tmp_path}/csv", LABELS["Company"].schema.names)
    back = {r.companyId: r for r in files.read_csv(spark, f"{tmp_path}/csv", LABELS["Company"].schema).collect()}
    assert back["C001"].name == 'Amazon.com, "Inc."' and back["C001"].cusip == "023135106"
    chunk = spark.createDataFrame([("CH001", 0, "t", [0.5])], LABELS["Chunk"].schema)
    files.write_json_lines(chunk, f"{tmp_path}/json")
    assert files.read_json_lines(spark, f"{tmp_path}/json", LABELS["Chunk"].schema).first().embedding == [0.5]
    files.backup(graph, f"{tmp_path}/backup")
    again = files.restore(spark, f"{tmp_path}/backup")
    assert pairs(again.edge_counts()) == pairs(graph.edge_counts())
    (tmp_path / "a.txt").write_text("  hello \n")
    got = files.read_texts(spark, f"{tmp_path}/a.txt").first()
    assert (got["name"], got.text, got.size) == ("a.txt", "hello", 5)
    for stamp in ("20240101", "20250101"):
        (tmp_path / f"plan_{stamp}").mkdir()
    assert files.latest_path(spark, str(tmp_path), "plan_").endswith("20250101") and files.latest_path(spark, str(tmp_path), "none_") is None
    meta = spark.createDataFrame([("x/y/f.pdf", "A", 1), ("z/f.pdf", "B", 2), ("", "C", 3), (None, "D", 4)], "p string, name string, n int")
    assert [(r.file, r.name) for r in files.company_metadata(meta, "p", F.col("n")).select("file", "name").collect()] == [("f.pdf", "B")]


def test_surrogates(spark):
    rows = spark.range(1100).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
    got = {r.name: r.surrogate_id for r in files.with_surrogate_ids(rows, ["name"], "C").collect()}
    assert got["n00000"] == "C001" and got["n01099"] == "C1100" and len(set(got.values())) == 1100


def test_expressions(spark):
    row = spark.createDataFrame([("Amazon", "```json\n{}\n```", "a b/c", "  x \t y ")], "n string, j string, f string, w string")
    got = row.select(X.canonical_name(F.col("n"), X.FILER_NAMES).alias("n"), X.unfenced(F.col("j")).alias("j"), X.safe_file_name(F.col("f")).alias("f"), X.collapsed(F.col("w")).alias("w"), X.first_filled(F.lit(" "), F.col("n")).alias("c")).first()
    assert tuple(got) == ("Amazon.com, Inc.", "{}", "a_b_c", "x y", "Amazon")


def test_labels_lists_and_filers(spark):
    nodes = spark.createDataFrame([("a", "A", ["X"])], "id string, name string, labels array<string>")
    rows = spark.createDataFrame([("a", "1", ["Y"], 1), ("a", "2", ["X", "Z"], 2), ("b", "3", ["Y"], 1), (None, "n", ["Q"], 1)], "id string, name string, labels array<string>, n int")
    got = {r.id: (r.name, r.labels) for r in mutate.merge_and_label(nodes, rows, "id", "labels", F.col("n")).collect()}
    assert got == {"a": ("2", ["X", "Y", "Z"]), "b": ("3", ["Y"])}
    named = spark.createDataFrame([("1", "Acme"), ("2", "Acme Corp"), ("3", "Acme"), ("4", None)], "id string, name string")
    assert pairs(mutate.listed_merges(named, "id", "name", [("Acme", "Acme Corp"), ("Nobody", "Acme")])) == [("1", "2")]
    texts = spark.createDataFrame([('Blue Harbor, Inc. (the "Company") is', None), ("Acme Holdings Corp of Ohio", {"filing_company": " "}), ("no name", {"company": "X"}), (None, None)], "t string, p map<string,string>")
    assert [r.c for r in texts.select(X.associated_company(F.col("p"), F.col("t")).alias("c")).collect()] == ["Blue Harbor, Inc.", "Acme Holdings Corp", "X", "unknown"]
    lists = [spark.createDataFrame(x, "k string, score double") for x in ([("a", 0.9), ("b", 0.8)], [("b", 5.0), ("c", 4.0)])]
    assert [r.k for r in fulltext.reciprocal_ranks(lists, "k", 2).collect()] == ["b", "a"]
