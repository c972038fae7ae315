"""Value splitting against a plain reading of single texts, and its edge cases."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigraph.operators.split_values import split_array, split_values

ITEMS = ["thermal battery packs", "plug and play hub", "on/off relay", "R&D toolkit", "10,000-cycle hinge", "real-time search"]
JOINTS = ["; ", ";", " ;", " | ", "|", "||", "\t", "\n", "\r\n- ", " • ", " · ", " – ", " // ", " / ", " + ", "; ;", ", "]


def rows(texts, offices=False):
    parents, pos, items = split_array(pa.array(texts, pa.string()), offices)
    return list(zip(parents.tolist(), pos.tolist(), items.to_pylist(), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ITEMS), min_size=2, max_size=6), st.sampled_from(JOINTS), st.booleans())
def test_joined_items_come_back(items, joint, pad):
    text = joint.join(items)
    if joint.startswith("\r\n- "):
        text = "- " + text
    got = rows([None, "  " + text + " " if pad else text, ""])
    assert got == [(1, i + 1, x) for i, x in enumerate(items)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*ITEMS, "kits, small", "seals; spare", "inputs | outputs board"]), min_size=2, max_size=5), st.sampled_from([", ", "; ", " | ", ",", "\n", "\t"]), st.sampled_from("\"'"))
def test_quoted_items_come_back(items, joint, quote):
    assert [x for _, _, x in rows([joint.join(quote + i + quote for i in items)])] == items


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from([*ITEMS, "kits, small", 'the "Atlas" line']), min_size=2, max_size=5))
def test_list_literals(items):
    import json

    assert [x for _, _, x in rows([repr(items)])] == items
    assert [x for _, _, x in rows([json.dumps(items)])] == items


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CFO, Treasurer and Founder", ["CFO", "Treasurer", "Founder"]), ("General Counsel, and Treasurer", ["General Counsel", "Treasurer"]), ("Head of Sales & Marketing", []),
        ("Chair of the Audit and Risk Committee", []), ("EVP, Global Operations", []), ("EVP, Global Operations; CFO", ["EVP, Global Operations", "CFO"]), ("Treasurer/CEO/Chief Operating Officer", ["Treasurer", "CEO", "Chief Operating Officer"]),
        ("Director of Mergers/Acquisitions", []), ("(1) CFO (2) Chief Operating Officer", ["CFO", "Chief Operating Officer"]), ("1. CEO 2. Controller", ["CEO", "Controller"]),
        ("/EVP // CFO", ["EVP", "CFO"]), ("President; CEO;", ["President", "CEO"]), (";Director", []), ("n/a", []), ("CFO", []), ("President | Director; Secretary", ["President", "Director", "Secretary"]),
        ("CFO; CFO", ["CFO", "CFO"]), ('"EVP, Global Operations", Chairman', ["EVP, Global Operations", "Chairman"]), ("'CEO'\r\n- 'CFO'", ["CEO", "CFO"]),
    ],
)
def test_titles(text, want):
    assert [x for _, _, x in rows([text], offices=True)] == want


def test_indented_bullets():
    assert [x for _, _, x in rows(["  - a b\n   - c d "])] == ["a b", "c d"]
    assert rows(["low-power set - small"]) == []


def test_prose_stays_whole():
    for text in ("Sold to ports, mills and schools; prices vary by region.", "Built for farms, clinics and airlines - support is billed apart!", "Our plan for schools, libraries and other bodies / non-profits."):
        assert rows([text]) == []


def test_csv_doubled_quotes():
    assert [x for _, _, x in rows(['"the ""Atlas"" line";portable search'])] == ['the "Atlas" line', "portable search"]


def test_frame_edges(spark):
    long_ = "; ".join(f"item number {i}" for i in range(20000))
    df = spark.createDataFrame([("a", "x y; z w", 1, "c"), (None, "p q; r s", 2, "c"), ("b", None, 3, "c"), ("b", "", 3, "c"), ("l", long_, 4, "c"), ("a", "x y; z w", 1, "c")], "id string, body string, pos int, item string")
    got = split_values(df, "id", "body", "t").collect()
    assert sum(r.record_id == "l" for r in got) == 20000
    assert sorted((str(r.record_id), r.pos, r.item) for r in got if r.record_id != "l") == [("None", 1, "p q"), ("None", 2, "r s"), ("a", 1, "x y"), ("a", 1, "x y"), ("a", 2, "z w"), ("a", 2, "z w")]
    assert split_values(df.limit(0), "id", "body", "t").count() == 0


def test_items_hold_no_delimiter(spark):
    got = rows(["a b ;c d ; ;e f", "a b\tc d", "- a b\r\n- c d\n"])
    assert all(not re.search(r"[;\t\n]", x) for _, _, x in got) and len(got) == 7


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a) thermal packs b) plug and play hub c) R&D toolkit", ["thermal packs", "plug and play hub", "R&D toolkit"]), ("100. thermal packs 101. plug and play hub", ["thermal packs", "plug and play hub"]), ("1) CFO board 2) cold storage", ["CFO board", "cold storage"]),
        ("‣ thermal packs ‣ seals kit", ["thermal packs", "seals kit"]), ("thermal packs › seals kit", ["thermal packs", "seals kit"]), ("▪ thermal packs\n▪ seals kit", ["thermal packs", "seals kit"]), ("thermal packs、seals kit；spare hub", ["thermal packs", "seals kit", "spare hub"]),
        ("Class a) of 3. grade steel", []), ("3.5 inch drive", []),
    ],
)
def test_other_marks(text, want):
    assert [x for _, _, x in rows([text])] == want
