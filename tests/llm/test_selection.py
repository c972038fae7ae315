"""Neighbours, packing, mixing and residue against brute force and invariants, and their edge cases."""

import math
import os
import time
from pathlib import Path

import numpy as np
import pytest

from filigraph.llm import mixing, neighbours, packing, residue, tokens


def clustered(n, width=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, width))
    x = centres[rng.integers(len(centres), size=n)] + 0.15 * rng.normal(size=(n, width))
    return (x * rng.uniform(0.2, 5, size=(n, 1))).astype(np.float32)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argpartition(-row, k)[:k].tolist()) for row in s]


def recall(spark, x, relax, shard_rows):
    df = spark.createDataFrame([(f"{i:06}", v.tolist(), "own") for i, v in enumerate(x)], "chunk string, vec array<float>, other string")
    found = {}
    for r in neighbours.nearest(df, "chunk", "vec", x.shape[1], 5, relax, shard_rows).collect():
        found.setdefault(int(r.id), set()).add(int(r.other))
    want = exact(x, 5)
    assert all(len(found[i]) == 5 and i not in found[i] for i in range(len(x)))
    return sum(len(found[i] & want[i]) for i in range(len(x))) / (5 * len(x))


def test_neighbours_exact_and_relaxed(spark):
    x = clustered(3000)
    assert recall(spark, x, 1.0, 800) > 0.9999
    assert recall(spark, x, 0.19, 800) > 0.95


def test_hot_shard_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 500)
    assert recall(spark, clustered(1500, seed=3), 1.0, 1500) > 0.9999


def test_waves_of_neighbours(spark, monkeypatch):
    """Many waves, blocks of one shard among them, miss nothing; the disk in use follows the vectors, not the questions."""
    monkeypatch.setattr(neighbours, "WAVE_ROWS", 700, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 500)
    x = clustered(3000, seed=11)
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    folders = [spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), *disk.localDirsString()]
    total = lambda: sum(p.stat().st_size for d in folders for kind in ("*.parquet", "shuffle_*.data") for p in Path(d).rglob(kind) if p.exists())
    used, write, start = [], neighbours.cut, total()

    def measured(*a, **k):
        out = write(*a, **k)
        time.sleep(0.3)
        used.append(total() - start)
        return out

    monkeypatch.setattr(neighbours, "cut", measured)
    assert recall(spark, x, 1.0, 1600) > 0.9999
    assert max(used) < 3 * 256 * len(x), (max(used), 256 * len(x))
    assert neighbours.waves({0: 10, 1: 10, 2: 10}, {0: 5, 1: 5, 2: 1300}, {0: 1, 1: 1, 2: 2}, 1000) == [(0, 1, 0, 0), (2, 2, 0, 0), (2, 2, 1, 1), (2, 2, 2, 2)]


def test_router_of_several_stages(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STAGE_LEVELS", 2)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 400)
    x = clustered(2400, seed=9)
    assert recall(spark, x, 1.0, 150) > 0.9999
    vectors = neighbours.usable_vectors(spark.createDataFrame([(f"{i:06}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>"), "id", "v", 64)
    router = neighbours.fitted_router(vectors, 64, 2400, 150)
    sizes = vectors.groupBy(neighbours.home_shard(vectors, router, 64).alias("s")).count().toPandas()["count"]
    assert router.depth == 4 and len(sizes) == 16 and sizes.max() < 400


def test_recall_on_other_vectors(spark):
    """The default factor was chosen on another table; here every row divisible by 20 is asked against all rows."""
    folder = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(folder):
        pytest.skip("the test tables are not here")
    df = spark.read.parquet(folder)
    rows = df.toPandas()
    x = np.stack(rows["embedding"]).astype(np.float32)
    want = dict(zip(rows["vec_id"], exact(x, 5), strict=True))
    found = {}
    for r in neighbours.nearest(df.withColumn("vec_id", df.vec_id.cast("string")), "vec_id", "embedding", 64, shard_rows=60).collect():
        found.setdefault(int(r.id), set()).add(int(r.other))
    asked = [i for i in want if i % 20 == 0]
    ids = rows["vec_id"].to_numpy()
    assert sum(len(found[i] & set(ids[list(want[i])].tolist())) for i in asked) >= 0.9 * 5 * len(asked)


def test_bound_is_kept():
    """Neighbours at or below the known bound are neither kept nor counted."""
    x = clustered(900, seed=5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best, ids = neighbours.search(x, x, np.arange(900), 5, 1.0)
    kept, rows = neighbours.search(x, x, np.arange(900), 5, 1.0, best[:, 1] + np.float32(1e-6))
    assert (np.count_nonzero(rows >= 0, axis=1) <= 1).all() and np.allclose(kept[rows[:, 0] >= 0, 0], best[rows[:, 0] >= 0, 0])


def test_neighbours_edges(spark):
    bad = [("n", None), ("s", [1.0, 2.0]), ("z", [0.0] * 4), ("f", [float("nan"), 1.0, 1.0, 1.0]), ("i", [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), ("h", [None, 1.0, 1.0, 1.0])]
    good = [("a", [1.0, 0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0, 0.0]), ("b", [2.0, 0.1, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(bad + good, "id string, v array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest_pairs(df, "id", "v", 4, 1, 1.0).collect())
    assert got == [("a", "b"), ("b", "c")]
    assert neighbours.nearest_pairs(df.limit(0), "id", "v", 4).count() == 0
    assert neighbours.nearest_pairs(spark.createDataFrame(good[:2], "id string, v array<float>"), "id", "v", 4).count() == 0


def tightest(sizes, sources, clusters, capacity, apart):
    """Best fit by looking at every bin."""
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i])):
        fits = [b for b in bins if b["left"] >= sizes[i] and clusters[i] not in b["clusters"] and not (b["sources"] & apart.get(1 << sources[i], 0))]
        best = min(fits, key=lambda b: (b["left"], b["n"]), default=None)
        if best is None:
            best = {"left": capacity, "n": len(bins), "clusters": set(), "sources": 0}
            bins.append(best)
        best["left"] -= sizes[i]
        best["clusters"].add(clusters[i])
        best["sources"] |= 1 << sources[i]
        out[i] = best["n"]
    return out, len(bins)


def test_best_fit_against_all_bins():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = 80
        sizes, sources, clusters = rng.integers(1, 60, n).tolist(), rng.integers(0, 3, n).tolist(), rng.integers(0, 50, n).tolist()
        by_cluster = {c: s for c, s in zip(clusters, sizes, strict=True)}
        sizes = [by_cluster[c] for c in clusters]  # copies have one size
        got = packing.best_fit(sizes, sources, clusters, 100, {1: 2, 2: 1})
        _, bins = tightest(sizes, sources, clusters, 100, {1: 2, 2: 1})
        load = {}
        for i, b in enumerate(got):
            load.setdefault(b, []).append(i)
        for items in load.values():
            assert sum(sizes[i] for i in items) <= 100 and len({clusters[i] for i in items}) == len(items)
            assert not {0, 1} <= {sources[i] for i in items}
        assert len(load) <= bins + 1


def test_packed(spark):
    rows = [(i, ["a", "b", None][i % 3], i % 40, 10 + i % 37) for i in range(400)] + [(900, "a", 900, 250), (901, "b", 901, 200), (902, "a", 902, 1)] + [(1000 + i, "a", 7777, 30) for i in range(150)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, cluster bigint, tokens int")
    containers = spark.createDataFrame([("s", 100), ("l", 400), (None, 5), ("bad", 0)], "container string, capacity_tokens int")
    got = packing.packed(sized, containers, (("a", "b"),), shard_items=200).toPandas()
    sizes = {"s": 100, "l": 400}
    assert set(got.container) == set(sizes)
    source, cluster = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    for (container, _), group in got.groupby(["container", "bin"]):
        assert group.tokens.sum() <= sizes[container]
        if len(group) > 1:
            assert not {"a", "b"} <= {source[d] for d in group.doc_id}
            assert len({cluster[d] for d in group.doc_id}) == len(group)
    for container in sizes:
        assert got[got.container == container].tokens.sum() == sum(r[3] for r in rows)
        cut = got[(got.container == container) & (got.piece > 1)].doc_id
        assert all(dict((r[0], r[3]) for r in rows)[d] > sizes[container] for d in cut)
    assert packing.packed(sized.limit(0), containers).count() == 0
    assert packing.fill_rates(packing.packed(sized, containers), containers).count() == 2


def test_mixing_shares(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big", int(t)) for i, t in enumerate(rng.integers(5, 400, 6000))] + [(10_000 + i, "small", int(t)) for i, t in enumerate(rng.integers(5, 400, 500))] + [(20_000, None, 50), (20_001, "untargeted", 50)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    selection = mixing.mixed(sized, targets)
    shares = {r.source: r for r in mixing.reached_shares(selection, targets).collect()}
    assert shares["big"].reached_share == pytest.approx(0.6, abs=0.01) and shares["small"].reached_share == pytest.approx(0.4, abs=0.01)
    assert shares["small"].most_repeats <= 3 and shares["big"].most_repeats == 1 and shares["absent"].tokens == 0
    per = selection.groupBy("doc_id").count().toPandas()
    small = per[per.doc_id.between(10_000, 19_999)]["count"]
    wanted = {r.source: r.copies for r in mixing.wanted_sizes(sized, targets).collect()}
    assert set(small) <= {math.floor(wanted["small"]), math.ceil(wanted["small"])}
    # a total that a source cannot reach is reached as far as its repeats permit
    capped = {r.source: r for r in mixing.reached_shares(mixing.mixed(sized, targets, 10**9), targets).collect()}
    assert capped["big"].tokens == sum(r[2] for r in rows if r[1] == "big") and capped["small"].most_repeats == 3
    assert mixing.mixed(sized.limit(0), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, "b", ""), (4, None, "hello world"), (5, "c", "naïve <|endoftext|> " * 3000), (None, "c", "x")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r for r in tokens.sized_documents(df).collect()}
    assert set(got) == {1, 4, 5} and got[1].tokens == 2 and got[1].cluster == got[4].cluster and got[5].tokens > 9000


PROSE = [
    "The board approved a buyback of up to $844 million; 917 thousand shares were bought in the quarter.", "Browsers that block JavaScript limit the reach of our advertising tools.", "Pricing follows the set {list, net, spot} that is named in each contract.",
    "The amounts in [brackets] are negative, and figures marked [a] are restated.", "Visits that ended in a 404 or other error page fell by 14.0% after we moved our store to new servers.", "The placeholder pill used in the trial caused no side effects in 268 patients.",
    "Our form builder lets staff insert a client's name <b>once</b> for all letters.", "Amounts to be determined by arbitration (TBD in the table) relate to the Estrelle claim.", "We make void filler and dummy cartridges used in packaging and in training.",
    "The session expired without agreement, and talks with the union resume in 2019.", "Growth was 31.6% (47.6% without currency effects) [1], [2].", "The contract number is X-754 and the share class is XX.",
]
RESIDUE = [
    "Our principal office is at {{company_name}}. Growth was slow.", "Sales reached [TICKER TO COME] in the period.", "The tax rate was %s, which differs.", "This report is dated XX/XX/20XX and covers one year.", "Dear <<first name>>, enclosed are the voting materials.",
    "We face rivals such as &lt;auditor&gt; and others.", "Shares of {0} and {1} were sold.", "Tellus velit lorem ipsum porta sapien magna.", "Growth was slow. This is dummy text.", "Sample copy for section 12...", "Error 404. Reference no. 12. Please try again later.",
    "<html><body><h1>Please enable JavaScript to view this filing.</h1></body></html>", "Menu\n\nThe page you requested could not be found (code 404).\n\nHome | Filings | Help", "Diese Seite benötigt Skripte.", "Sorry, that report was moved or removed!",
]


def test_residue(spark):
    prose = [f"{a} {b} Backlog at quarter end stood at ${i} million." for i in range(8) for a in PROSE for b in PROSE]
    docs = [(i, t, "en") for i, t in enumerate(prose)] + [(10_000 + i, t, "en") for i, t in enumerate(RESIDUE)] + [(20_000, None, None), (20_001, "", "en"), (20_002, " ", "en"), (20_003, "We sell pumps. " * 20_000, "en"), (20_004, "We sell pumps. " * 20_000 + "Sales reached {{amount}}.", "en"), (20_004, "Sales {{amount}}.", "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, template string")
    found = {r.doc_id for r in residue.residue_documents(df).collect()}
    want = {10_000 + i for i in range(len(RESIDUE))} | {20_004}
    assert found == want, {t for i, t, _ in docs if i in found ^ want}
    assert residue.without_residue(df).count() == len(docs) - len(RESIDUE) - 2
    assert residue.residue_documents(df.limit(0)).count() == 0


#: Residue of kinds that no seed text holds.
UNSEEN = [
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere.", "Phasellus blandit massa enim, quis rhoncus nulla hendrerit in.", "Replace this text with your own content.", "Dear [Recipient], thank you for the order.", "Signed by [Applicant Surname] in London.",
    "Revenue was {{ fiscal_quarter | upper }} in the year.", "You do not have permission to open this document. Contact your administrator.", "The lease of ${leaseHolder.street} ended.", "Our auditor is <<audit firm>> of Leeds.", "Sales of %%region_name%% rose.",
    "Add a short summary here.", "Dummy headline text to be replaced.", "HTTP 418: the server refused the attempt.", "Please turn on JavaScript in your settings and reload.", "Your login session has timed out. Sign in again.", "Error 522: connection to the origin server timed out.",
    "Sorry, the page that you are looking for does not exist.", "Scripts are blocked by your browser; allow them to view this page.", "The chair is [INSERT NAME OF CHAIR].", "The fee is #{fee_total} a month.",
]
TALK = [
    "We train staff with the phrase lorem ipsum dolor sit amet as an example of what may not be filed.",
    "Our linter checks `__init__` methods and `%s` formatting in the code of vendors.", 'Designers use the phrase "lorem ipsum dolor sit amet" as an example of dummy text in a mock-up.', "Item 6 is marked [Reserved] in this form.", "Some visitors turn off scripts in their browser, which lowers our advertising sales.",
    "Access to the site was denied to a supplier in the year, which we regret.", "A 404 error on our store cost us sales of $12 million.", "The template field for the client name is filled by staff before a letter is sent.", "The parties will insert the agreed price into the final contract.",
]


def test_residue_of_unseen_kinds(spark):
    prose = [f"{a} {b} Backlog at quarter end stood at ${i} million." for i in range(8) for a in PROSE for b in PROSE]
    docs = [(i, t) for i, t in enumerate(prose)] + [(10_000 + i, t) for i, t in enumerate(UNSEEN)] + [(20_000 + i, t) for i, t in enumerate(TALK)]
    found = {r.doc_id for r in residue.residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    missed, wrong = [UNSEEN[i] for i in range(len(UNSEEN)) if 10_000 + i not in found], [TALK[i] for i in range(len(TALK)) if 20_000 + i in found]
    assert len(missed) <= 0.1 * len(UNSEEN) and not wrong, (missed, wrong)
    known = {x.strip() for texts in residue.seeds().values() for x in texts}
    assert not known & set(UNSEEN) and not {i for i in found if i < 10_000}
