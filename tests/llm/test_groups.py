"""Components, survivors, canonical mapping and spelling variants against plain versions, and their edge cases."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from filigraph.llm import canonical, names, queries, survivors, variants
from filigraph.llm.components import connected_groups, merge_groups, says_merge


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a.strip() and b.strip() and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((find(x), x) for x in parent)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(45)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [("hub", f"h{i}") for i in range(30)]
    edges += [(None, "n001"), ("n002", None), ("", "n003"), (" ", "n004"), ("self", "self")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in edges], "a string, b string, v int, m string")
    got = sorted((r.group_id, r.element_id) for r in connected_groups(df, "a", "b").collect())
    assert got == union_find(edges)


def test_no_edges(spark):
    assert connected_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_verdicts(spark):
    words = [("merge", True), ("Merge.", True), ('"merge"', True), (" MERGED ", True), ("no_merge", False), ("do not merge", False), ("not merged", False), ("unsure", False), ("", False), (None, False)]
    got = spark.createDataFrame(words, "d string, want boolean").select(says_merge(F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    rows = [("a", "b", "merge"), ("b", "c", "no_merge"), ("c", "d", "Merged")]
    df = spark.createDataFrame(rows, "entity_a_element_id string, entity_b_element_id string, decision string")
    assert sorted(tuple(r) for r in merge_groups(df).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")]


SCHEMA = "element_id string, name string, label string, labels array<string>, properties map<string,string>, source_chunks array<string>, relationship_count bigint, exported_at timestamp_ntz"


def entity(i, name="N", label="L", props=None, chunks=(), rel=1, day=1):
    return (i, name, label, [label], props, list(chunks) if chunks is not None else None, rel, dt.datetime(2024, 1, day))


def test_survivor_and_donors(spark):
    rows = [
        entity("a", props={"x": "1", "y": "n/a", "__k": "v"}), entity("b", props={"y": "2", "z": " "}, rel=5), entity("c", props={"x": "TBD", "w": "3"}, rel=None),
        entity("a", props={"q": "old"}, day=1, rel=9)[:7] + (dt.datetime(2020, 1, 1),), entity("s", name="alone", props={"x": "1"}), entity("n", name=None), entity("n2", name=None), entity("e", name=" "), entity("e2", name=" "),
        entity("p", name="none", props=None), entity("p2", name="none", props={}),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.survivor_id, r.prop, r.donor_id) for r in survivors.group_survivors(df).collect())
    assert got == [("b", "w", "c"), ("b", "x", "a"), ("b", "y", "b")]
    fused = sorted((r.survivor_id, r.prop, r.donor_id) for r in survivors.fused_values(df).collect())
    assert fused == got
    assert survivors.fused_values(df.limit(0)).count() == 0


def test_rank_order(spark):
    rows = [entity("d", props={"x": "1"}, chunks=["k", "k"], rel=2), entity("c", props={"x": "2"}, chunks=["k", "l"], rel=2), entity("b", props={"x": "3"}, chunks=None, rel=2), entity("a", props={"x": "4"}, chunks=["k", "l", None], rel=1)]
    assert survivors.group_survivors(spark.createDataFrame(rows, SCHEMA)).first().survivor_id == "c"


def test_fusion_discounts_copies(spark):
    """Two sources that share false values elsewhere do not outvote two independent ones."""
    rows = []
    for g in range(12):  # copy follows bad, both wrong; good and fair are right
        for source, value in (("good", "T"), ("fair", "T"), ("third", "T"), ("bad", f"F{g}"), ("copy", f"F{g}")):
            rows.append(entity(f"{g}{source}", name=f"G{g}", props={"company": source, "v": value}))
    rows += [entity(f"z{s}", name="Z", props={"company": s, "v": v}) for s, v in (("good", "T"), ("bad", "F"), ("copy", "F"))]
    got = {r.name: r.fused_value for r in survivors.fused_values(spark.createDataFrame(rows, SCHEMA)).filter("prop = 'v'").collect()}
    assert got["Z"] == "T" and got["G0"] == "T"


def test_fusion_runs_where_it_decides(spark, monkeypatch, tmp_path):
    """Rows by rank do not wait for the fusion; the record that a fused value is taken from claims it."""
    rows = [entity(f"{g}{s}", name=f"G{g}", props={"company": s, "v": v}, rel=9 if s == "bad" else 1) for g in range(12) for s, v in (("good", "T"), ("fair", "T"), ("third", "T"), ("bad", f"F{g}"), ("copy", f"F{g}"))]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/snapshot_entities.parquet")
    got = {r.name: r for r in survivors.fused_values(df).filter("prop = 'v'").collect()}
    assert all((r.donor_id, r.value, r.fused_donor_id, r.fused_value) == (f"{n[1:]}bad", f"F{n[1:]}", f"{n[1:]}fair", "T") for n, r in got.items()) and len(got) == 12
    by_rank = sorted((r.survivor_id, r.prop, r.donor_id) for r in survivors.group_survivors(df).collect())
    monkeypatch.setattr(survivors, "scored_values", lambda *a: pytest.fail("the fusion ran for nothing"))
    assert sorted((r.survivor_id, r.prop, r.donor_id) for r in queries.p6_found(spark, str(tmp_path)).collect()) == by_rank


def test_pair_counts_against_double_loop(spark, monkeypatch):
    monkeypatch.setattr(survivors, "SLICE_PAIRS", 50)
    rng = random.Random(2)
    rows = {(k, rng.randrange(1200)): round(rng.random(), 3) for k in range(12) for _ in range(rng.randrange(1, 40))}
    weight = {k: w for (k, _), w in rows.items()}
    got = {(r.s1, r.s2): (r.w, r.one) for r in survivors.pair_counts(spark.createDataFrame([(k, s, weight[k], 1.0) for k, s in rows], "k long, s long, w double, one double"), ["k"], ["w", "one"]).collect()}
    want = {}
    for k, s in rows:
        for l, t in rows:
            if k == l and s < t:
                a, b = want.get((s, t), (0.0, 0.0))
                want[s, t] = (a + weight[k], b + 1)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_fusion_beats_majority_among_copiers(spark):
    rows = [entity(f"{g}{i}", name=f"G{g}", props={f"k{j}": f"v{g}" for j in range(4)}) for g in range(300) for i in range(2)]
    got = {r.rule: r for r in survivors.planted_accuracy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["fusion"].fields > 900 and got["fusion"].right >= 0.9 * got["fusion"].fields and got["majority"].right <= 0.65 * got["majority"].fields


def test_sql_of_groups_and_survivors(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for name in ("merge_decisions", "snapshot_entities"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, folder)
        found = con.sql(sql)
        at = [found.columns.index(c) for c in df.columns]
        assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall()), name


COMPANIES = [("C001", "Rafecejot General Insurance Ltd.", "RAEC", "4796000", "370000400"), ("C017", "Leferedat Software Inc.", "LEER", "7358016", "110000000"), ("C020", "Cameleser Data Foods plc", "CAFO", "0000123", "1")]


def test_canonical(spark):
    typed = [
        (None, "Leferedat Software Inc.", "C017"), ("", "The Leferedat  Sftwr, Inc", "C017"), ("", "Software Inc. (Leferedat)", "C017"), ("", "Leferedta Software", "C017"), ("", "Leferedat Capital Pte. Ltd.", "UNMATCHED"),
        ("", "Leferedat Global Foods plc", "UNMATCHED"), ("#C-17", "", "C017"), ("c 17", None, "C017"), ("CO017", "", "C017"), ("0007358016", "", "C017"), ("leer", "", "C017"), ("", "LEER", "C017"), ("C944", "Cameleser Foods", "C020"),
        ("n/a", "others", "UNMATCHED"), (None, None, "UNMATCHED"), ("", " ", "UNMATCHED"), ("?", "x " * 5000, "UNMATCHED"), ("", "RAFECEJOT GEN INS LTD", "C001"), ("", "RAFECEJOT GEN INS LTD", "C001"),
    ]
    rows = [(i, "S", a, b, "own") for i, (a, b, _) in enumerate(typed)] + [(99, "S", "C017", "whatever", "own")]
    df = spark.createDataFrame(rows, "row_id bigint, sourcecompanyid string, targetcompanyid string, targetcompanyname string, companyid string")
    listed = spark.createDataFrame(COMPANIES, "companyid string, name string, ticker string, cik string, cusip string")
    got = {r.row_id: r.companyid for r in canonical.matched_companies(df, listed).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(typed)}
    assert canonical.matched_companies(df.limit(0), listed).count() == 0
    assert {r.companyid for r in canonical.matched_companies(df, listed.limit(0)).collect()} == {"UNMATCHED"}


def test_lookup_by_shuffle(spark, monkeypatch):
    stem = "abcdefghijklmnopqrstuvw"
    typed = ["leferedat", "lefredat", "other", "ab", stem[:18] + "xx", stem[:20], stem[1:], stem * 100]
    listed = ["leferedat", "leferedet", "ab", "ac", stem[:18], stem[:20] + "z", stem, stem * 100 + "q"]
    a, b = (spark.createDataFrame([(w,) for w in words], "word string") for words in (typed, listed))
    want = sorted((r.word, r.ref_word) for r in canonical.near_words(a, b, 2).collect())
    monkeypatch.setattr(canonical, "BROADCAST_ROWS", 0)
    assert sorted((r.word, r.ref_word) for r in canonical.near_words(a, b, 2).collect()) == want
    assert want == sorted((x, y) for x in typed for y in listed if names.osa(x, y, 2) <= canonical.edits_allowed(x, y, 2))


def test_canonical_unseen_vocabulary(spark):
    """Names of ordinary words, none of them in a table: slips in any word, words joined, short forms, other companies."""
    listed = [("C1", "Blue Harbor Robotics Inc.", "BHR", "1", "11"), ("C2", "Quill River Bakery Ltd", "QRB", "2", "22"), ("C3", "Copper Lantern Shipyards plc", "CLS", "3", "33"), ("C4", "Quill Valley Tannery Ltd", "QVT", "4", "44")]
    typed = [
        ("Blue Harbour Robotics", "C1"), ("Blue Harbor Robtics", "C1"), ("Robotics, Blue Harbor", "C1"), ("BlueHarbor Robotics Inc", "C1"), ("Quill Rver Bakery", "C2"), ("Quill River Bakry Ltd", "C2"), ("The Quil River Bkry", "C2"),
        ("Coper Lantern Shipyards", "C3"), ("Copper Lantrn Shipyrds plc", "C3"), ("Blue Harbor Foods", "UNMATCHED"), ("Blue Harbor Robotics Europe", "UNMATCHED"), ("Quill River Bakery plc", "UNMATCHED"), ("Blue", "UNMATCHED"), ("Quill", "UNMATCHED"), ("local rivals", "UNMATCHED"),
    ]
    df = spark.createDataFrame([(i, "S", None, n) for i, (n, _) in enumerate(typed)], "row_id bigint, sourcecompanyid string, targetcompanyid string, targetcompanyname string")
    got = {r.row_id: r.companyid for r in canonical.matched_companies(df, spark.createDataFrame(listed, "companyid string, name string, ticker string, cik string, cusip string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(typed)}


def test_candidates_against_double_loop(spark):
    """Words with wrong neighbours only, shortened words and common ones lose no reference."""
    listed = ["Blue Robotics Mineral Ltd", "Rbtcz Foods Inc", "Mnrk Tools plc", "Internationally Automated Robotics", "Blueharbor Cargo", *(f"Blue {w.title()} {t.title()}" for w, t in zip(WORDS, TRADES, strict=False))]
    typed = ["Blue Rbtcs Mnrl", "Rbtcs Mnrl", "Internationaly Autmtd Rbtcs", "Intrenat Automat Robot", "Blue Harbor Crgo", "Blu Harbor Cargo", "Blue Cdr Millnry", "Blue", "Rbtcs Tools", "Mnrk", *(slip(random.Random(i), n.replace(" ", "")) for i, n in enumerate(listed))]
    entries = spark.createDataFrame([(n, 1) for n in typed], "typed_name string, n long")
    companies = spark.createDataFrame([(f"C{i:02}", n) for i, n in enumerate(listed)], "companyid string, name string")
    got = {r.typed_name: r.by_name for r in canonical.named_companies(entries, companies, 2).collect()}
    said = {f"C{i:02}": names.read_company(n) for i, n in enumerate(listed)}
    held = {}
    for words, *_ in said.values():
        for w in {*words, "".join(words)}:
            held[w] = held.get(w, 0) + 1
    want = {}
    for n in typed:
        near = {c: canonical.typed_distance(names.read_company(n), s, [math.log(1 + len(said) / held[w]) for w in s[0]], 2) for c, s in said.items()}
        if near := {c: d for c, d in near.items() if d is not None}:
            want[n] = {c for c, d in near.items() if d == min(near.values())}
    assert set(got) == set(want) and all(got[n] in want[n] for n in got)
    assert {got.get(n) for n in typed[:2]} == {"C00"} and got.get(typed[2]) == "C03"


def test_shortening_keys_keep_pairs():
    rng = random.Random(8)
    refs = [*WORDS, *TRADES, "internationalization", "electromagnetohydrodynamics" * 2]
    typed = {w[:n] for w in refs for n in range(2, len(w))} | {slip(rng, w[:n]) for w in refs for n in range(5, len(w)) for _ in range(4)} | {w[0] + "".join(c for c in w[1:] if rng.random() < 0.5) for w in refs for _ in range(20)}
    pairs = [(a, b) for a in typed for b in refs if names.shortens(a, b) or names.shortens_nearly(a, b)]
    assert len(pairs) > 500 and all(canonical.shortening_keys(a, True) & canonical.shortening_keys(b, False) for a, b in pairs)


def test_distances():
    assert names.osa("abcd", "abdc") == 1 and names.osa("abc", "xyz", 2) == 3 and names.osa("", "ab") == 2
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.jaro_winkler("a", "b") == 0
    assert canonical.weighted_distance("lefeat", "lefaet") < 1 <= canonical.weighted_distance("abc", "xbz")
    assert canonical.weighted_distance("a", "a") == 0


def test_variants(spark):
    one = ["Leferedat Software Inc.", "LEFEREDAT SFTWR INC /DE/", "Software Inc. (Leferedat)", "leferedat software", "Leferedat Inc", "Lefredat Software Inc.", "Léferedat Software Incorporated & Co", "LEER"]
    sister, subsidiary = ["Leferedat Global Foods plc", "LEFEREDAT GLBL FDS PLC"], ["Leferedat Capital Pte. Ltd."]
    ann, bob = ["Elizabeth M. Rihesutrax", "Rihesutrax, Liz", "RIHESUTRAX Beth", "E.M. Rihesutrax", "Dr. Elizabeth Rihsutrax, PhD"], ["Robert D. Rihesutrax", "Bob Rihesutrax"]
    rows = [(n, "C") for n in [*one, *sister, *subsidiary, "others", "x" * 5000]] + [(n, "P") for n in [*ann, *bob]] + [(None, "C"), ("", "C"), (one[0], "C")]
    symbols = spark.createDataFrame([("LEER", "Leferedat Software Inc."), (None, "x")], "symbol string, name string")
    got = {(r.name_a, r.name_b) for r in variants.variant_pairs(spark.createDataFrame(rows, "name string, kind string"), symbols).collect()}
    want = {tuple(sorted((x, y), key=lambda s: s.encode())) for group in (one, sister, ann, bob) for x in group for y in group if x != y}
    assert got == want
    assert variants.variant_pairs(spark.createDataFrame([], "name string, kind string")).count() == 0


WORDS = "amber anvil badger basalt beacon birch bramble canyon cedar cinder cobalt copper cornice dapple ember falcon fathom fennel garnet granite harbor heron hollow indigo ivory juniper kestrel lantern larch linden magnet maple marble meadow nickel nutmeg oriole osprey otter pebble pepper quarry quartz raven rowan saffron sable thicket thistle timber tundra velvet walnut willow zephyr".split()
TRADES = "bakery brewery cannery carpentry ceramics clockworks creamery distillery foundry glassworks hatchery joinery masonry millinery orchards pottery ropeworks saddlery sawmill shipyards smithy tannery upholstery vineyards weavers".split()
FIRST = "Abelard Bettina Caspian Delphine Evander Fiorella Giuseppe Hesper Ignatius Jocasta Leopold Marisol Nikolai Ottoline Percival Quirino Rosalind Sebastian Tamsin Ulrika".split()
LAST = "Ashdown Brackenbury Castellano Drummond Ellingham Fairweather Gallardo Hathersage Illingworth Jernigan Kowalczyk Lindqvist Montefiore Netherby Oyelaran Pemberton Quintanilla Ravensworth Stromberg Thackeray".split()


def slip(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return rng.choice((word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[:at] + word[at + 1] + word[at] + word[at + 2 :], word[:at] + rng.choice("aeiorstn") + word[at + 1 :]))


def unseen_names(rng):
    """Entities with their spellings, of a vocabulary that no table holds; sisters share two words, relatives a surname."""
    groups = []
    for k in range(150):
        a, b, t, u = *rng.sample(WORDS, 2), *rng.sample(TRADES, 2)
        form = rng.choice(("Inc.", "Ltd", "plc"))
        for trade in (t, u) if k % 4 == 0 else (t,):
            full = f"{a} {b} {trade}".title()
            spelt = {full, f"{full} {form}", f"{full.upper()} {form.upper()}", f"{trade.title()}, {a.title()} {b.title()}", f"The {full} {form}"}
            spelt |= {" ".join(slip(rng, w) if i == j else w for i, w in enumerate((a, b, trade))).title() + " " + form for j in range(3)}
            groups.append(("C", sorted(spelt)))
    for k in range(80):
        f, g, last, m = *rng.sample(FIRST, 2), rng.choice(LAST) + LAST[k % 20].lower(), rng.choice("BCDHKMNR")
        for first in (f, g) if k % 4 == 0 else (f,):
            groups.append(("P", sorted({f"{first} {last}", f"{first} {m}. {last}", f"{last}, {first}", f"{last} {first}", f"Dr. {first} {slip(rng, last)}", f"{slip(rng, first)} {m}. {last}"})))
    return groups


def test_variants_unseen_vocabulary(spark):
    rng = random.Random(11)
    groups = unseen_names(rng)
    lower = {w for table in (names.SHORT, names.NICKNAMES) for w in table.replace("\n", "").replace("|", " ").split()}
    assert not lower & {*WORDS, *TRADES, *(x.lower() for x in FIRST), *(x.lower() for x in LAST)}
    rows = [(n, kind) for kind, spelt in groups for n in spelt]
    got = {(r.name_a, r.name_b) for r in variants.variant_pairs(spark.createDataFrame(rows, "name string, kind string")).collect()}
    owners = {}
    for i, (_, spelt) in enumerate(groups):
        for n in spelt:
            owners.setdefault(n, set()).add(i)
    want = {(x, y) for _, spelt in groups for x in spelt for y in spelt if x < y}
    right = sum(1 for a, b in got if owners[a] & owners[b])
    assert len(want & got) >= 0.9 * len(want), (len(want & got), len(want))
    assert right >= 0.97 * len(got), (right, len(got))


def test_variants_ordinary_names(spark):
    same = [
        ("C", "Blue Harbor Robotics Inc.", "Robotics, Blue Harbor"), ("C", "Quill River Bakery Ltd", "Quil River Bakery"), ("C", "Eyl Software Inc", "Ely"),
        ("P", "Giuseppe Verdacchio", "Verdacchio Giuseppe"), ("P", "Francisco Delgado", "Paco Delgado"), ("C", "hifibubol cargo ltd", "hufbiubol cargo ltd"),
    ]
    others = [("C", "Blue Harbor Foods Inc."), ("P", "Maria Delgado"), ("C", "Quill Valley Tannery Ltd")]
    rows = [(n, k) for k, a, b in same for n in (a, b)] + [(n, k) for k, n in others]
    got = {frozenset((r.name_a, r.name_b)) for r in variants.variant_pairs(spark.createDataFrame(rows, "name string, kind string")).collect()}
    assert {frozenset(x[1:]) for x in same[:5]} <= got and not any(n in p for p in got for _, n in others)


def test_blocks_keep_pairs():
    """Blocking recall: of all pairs of words that the comparison takes for slips, those that share a block."""
    rng = random.Random(3)
    words = sorted({slip(rng, w) for w in (x.lower() for x in [*WORDS, *TRADES, *FIRST, *LAST]) for _ in range(6)} | {"ely", "eyl", "hifibubol", "hufbiubol", "maguwacal", "mauwacal", "a" * 40, "a" * 41})
    keys = {w: names.block_keys(w) for w in words}
    pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 2 and names.alike(a, b)]
    kept = sum(1 for a, b in pairs if keys[a] & keys[b])
    assert len(pairs) > 300 and kept == len(pairs)
