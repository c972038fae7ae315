"""Entity resolution: exact duplicates, candidate pairs, verdicts, components, gated groups, and their scoring."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph.tables import cut, drop_cut

#: Thresholds per label at which fuzzy candidates are taken.
THRESHOLDS = {"Company": 0.6, "Executive": 0.6, "Product": 0.85, "RiskFactor": 0.95, "FinancialMetric": 0.95}
HONORIFIC = r"^(?i)(Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Prof\.?|Sir|Dame)\s+"


def exact_duplicates(entities: DataFrame) -> DataFrame:
    """(label, name, survivor_id, members): groups of equal label and name; nulls count as ``''`` and form one group.

    ``entities`` has element_id, label, name, filled (number of properties) and relationship_count. The survivor has
    the most properties, then the most relationships, then the smallest id.
    """
    rank = F.struct((-F.col("filled")).alias("p"), (-F.coalesce("relationship_count", F.lit(0))).alias("r"), F.col("element_id").alias("id"))
    rows = entities.withColumn("name", F.coalesce("name", F.lit("")))
    grouped = rows.groupBy("label", "name").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("members"))
    return grouped.filter("members > 1").select("label", "name", F.col("first.id").alias("survivor_id"), "members")


def prefix_pairs(names: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """(a, b, score), a the shorter: pairs of which one lower-cased name begins the other, by share of its length.

    Every name is expanded to its own beginnings that are long enough, so the pairs come from an equi-join.
    """
    rows = names.select(F.col(key).alias("id"), F.lower(F.trim(name)).alias("n")).filter("n <> ''")
    least = F.greatest(F.lit(1), F.ceil(F.length("n") * threshold - 1e-9)).cast("int")
    long_ = rows.select(F.col("id").alias("b"), F.col("n").alias("whole"), F.explode(F.transform(F.sequence(least, F.length("n")), lambda i: F.substring(F.col("n"), F.lit(1), i))).alias("n"))
    pairs = long_.join(rows.withColumnRenamed("id", "a"), "n").filter((F.col("a") != F.col("b")) & ((F.length("n") < F.length("whole")) | (F.col("a") < F.col("b"))))
    return pairs.select("a", "b", F.round(F.length("n") / F.length("whole"), 6).alias("score"))


def honorific_pairs(names: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b, score) 0.7: pairs of equal last word of which exactly one name begins with an honorific."""
    rows = names.select(F.col(key).alias("id"), F.trim(name).alias("n")).filter("n <> ''")
    rows = rows.select("id", F.lower(F.element_at(F.split("n", r"\s+"), -1)).alias("last"), F.col("n").rlike(HONORIFIC).alias("title"))
    a, b = rows.filter("title").select(F.col("id").alias("a"), "last"), rows.filter("not title").select(F.col("id").alias("b"), "last")
    return a.join(b, "last").select("a", "b", F.lit(0.7).alias("score"))


def weighted_ratio(a: str, b: str) -> float:
    """Similarity of two names in [0, 1]: the best of plain, sorted-word, word-set and partial matching."""
    x, y = _clean(a), _clean(b)
    if not x or not y:
        return 0.0
    ratio = lambda p, q: SequenceMatcher(None, p, q, autojunk=False).ratio()
    best = ratio(x, y)
    s, t = sorted(x.split()), sorted(y.split())
    best = max(best, 0.95 * ratio(" ".join(s), " ".join(t)))
    common, only_s, only_t = sorted(set(s) & set(t)), sorted(set(s) - set(t)), sorted(set(t) - set(s))
    if common:
        base = " ".join(common)
        best = max(best, 0.95 * max(ratio(base, " ".join(common + only_s)), ratio(base, " ".join(common + only_t)), ratio(" ".join(common + only_s), " ".join(common + only_t))))
    short, long_ = sorted((x, y), key=len)
    if len(long_) >= 1.5 * len(short) and short in long_:
        best = max(best, 0.9 if len(long_) < 8 * len(short) else 0.6)
    return best


#: Cleaned names per block: two blocks meet in one group, so this bounds what a Python worker holds.
BLOCK = 2000
#: Character classes whose counts bound a score: letters, digits, the blank, and the rest by code point.
CLASSES = 48


def _clean(name: str) -> str:
    """Lower case, everything but letters and digits a blank, blanks collapsed; what scores look at."""
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _counts(name: str) -> np.ndarray:
    out = np.zeros(CLASSES, dtype="uint16")
    for c in name:
        out[ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36 if c == " " else 37 + ord(c) % 11] += 1
    return out


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits; matching blocks never cover more."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Block:
    """Cleaned names with what bounds their scores: character counts, lengths, and the places of each word."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.sorted = names, [" ".join(sorted(n.split())) for n in names]
        self.words = [sorted(set(n.split())) for n in names]
        self.counts = np.stack([_counts(n) for n in names], axis=1)
        self.length = np.array([len(n) for n in names], dtype="float64")
        self.distinct = np.array([sum(map(len, w)) + len(w) - 1 for w in self.words], dtype="float64")
        places: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            for w in words:
                places.setdefault(w, []).append(i)
        self.places = {w: np.array(at) for w, at in places.items()}

    def near(self, other: _Block, i: int, start: int, threshold: float) -> Iterator[int]:
        """Places from ``start`` on whose score with name ``i`` of ``other`` may reach ``threshold``; none that does is left out.

        The score is at most what the common characters would give if all of them matched in order, in the plain names,
        the sorted and the distinct words; word sets are exact by the length of their common words.
        """
        least = threshold - 1e-6  # scores are rounded before they are compared
        shared = np.minimum(self.counts[:, start:], other.counts[:, i : i + 1]).sum(axis=0, dtype="uint32").astype("float64")
        common = np.zeros(len(self.names))
        for w in other.words[i]:
            if (at := self.places.get(w)) is not None:
                common[at] += len(w) + 1
        common = np.maximum(common[start:] - 1, 0)
        length, distinct = self.length[start:], self.distinct[start:]
        short, long_, few = np.minimum(length, other.length[i]), np.maximum(length, other.length[i]), np.minimum(distinct, other.distinct[i])
        plain = 2 * shared >= least * (length + other.length[i])
        inside = (shared >= short) & (long_ >= 1.5 * short) & (np.where(long_ < 8 * short, 0.9, 0.6) >= least)
        sets = (common > 0) & (0.95 * np.maximum(2 * common / (common + few), 2 * shared / (distinct + other.distinct[i])) >= least)
        words = (common > 0) & (0.95 * 2 * common >= least * (common + few))
        x = other.names[i]
        for k in np.flatnonzero(plain | inside | sets):
            j = start + int(k)
            total = least * (len(x) + len(self.names[j]))
            if words[k] or inside[k] or (sets[k] and self._sets_may(other, i, j, least)) or 2 * _common_length(x, self.names[j]) >= total or 1.9 * _common_length(other.sorted[i], self.sorted[j]) >= total:
                yield j

    def _sets_may(self, other: _Block, i: int, j: int, least: float) -> bool:
        s, t = other.words[i], self.words[j]
        both = [w for w in s if w in t]
        x, y = (" ".join(both + [w for w in ws if w not in both]) for ws in (s, t))
        return 1.9 * _common_length(x, y) >= least * (len(x) + len(y))


def fuzzy_pairs(names: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """(a, b, score), a < b: all pairs that are alike enough.

    Every two distinct cleaned names meet: they are dealt to blocks by hash, each two blocks meet in one group by an
    equi-join, and within it bounds that no score exceeds say which pairs are scored. The work grows with the square of
    the distinct names, the memory of a worker with a block.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less keeps every pair")
    cleaned = F.pandas_udf(lambda x: x.map(_clean), "string")
    rows = cut(names.select(F.col(key).alias("id"), F.col(name).alias("n")).filter(F.trim("n") != "").withColumn("n", cleaned("n")).filter("n <> ''"))
    once = cut(rows.groupBy("n").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    blocks = max(1, -(-once.count() // BLOCK))
    dealt = once.withColumn("own", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"p": F.least("own", "met"), "q": F.greatest("own", "met")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", ignore_index=True)
        p, q = group["p"].iat[0], group["q"].iat[0]
        left, right = group[group["own"] == p], group[group["own"] == q]
        out: list[tuple[str, str, float]] = []
        if len(left) and len(right):
            x, y = _Block(left["n"].tolist()), _Block(right["n"].tolist())
            ends = [list(zip(part["low"], part["high"], strict=True)) for part in (left, right)]
            for i, n in enumerate(x.names):
                for j in y.near(x, i, i + 1 if p == q else 0, threshold):
                    m, (low, high), (low_m, high_m) = y.names[j], ends[0][i], ends[1][j]
                    # the order matters to a score, so each is taken only if ids in that order exist
                    out += [(c, d, weighted_ratio(c, d)) for c, d, some in ((n, m, low < high_m), (m, n, low_m < high)) if some]
        found = pd.DataFrame(out, columns=["n", "m", "score"]).astype({"score": "float64"})
        return found[found["score"].round(6) >= threshold]

    alike = dealt.groupBy("p", "q").applyInPandas(compare, "n string, m string, score double")
    alike = cut(alike.unionByName(once.filter("low < high").select("n", F.col("n").alias("m"), F.lit(1.0).alias("score")).filter(F.col("score") >= threshold)))
    pairs = alike.join(rows.withColumnRenamed("id", "a"), "n").join(rows.select(F.col("id").alias("b"), F.col("n").alias("m")), "m")
    return pairs.filter("a < b").select("a", "b", F.round("score", 6).alias("score"))


def honorific_stages(names: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """(a, b, score), a < b: the score of the names where it reaches ``threshold``, else that of the names without
    honorifics where it does, else 0.7 for equal last words of which exactly one name has an honorific."""
    bare = names.select(F.col(key).alias("id"), F.trim(F.regexp_replace(F.col(name), HONORIFIC, "")).alias("n"))
    last = honorific_pairs(names, key, name).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").alias("s3"))
    first, second = (p.withColumnRenamed("score", s) for p, s in ((fuzzy_pairs(names, key, name, threshold), "s1"), (fuzzy_pairs(bare, "id", "n", threshold), "s2")))
    found = first.join(second, ["a", "b"], "full_outer").join(last, ["a", "b"], "full_outer")
    return found.select("a", "b", F.coalesce("s1", "s2", "s3").alias("score"))


def component_labels(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that is reachable, by minimum labels with pointer jumping."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("n"))
        low = label.join(near, label.id == near.a).select("id", F.least("component", "n").alias("c"), "component")
        jump = label.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new = cut(low.join(jump, "c", "left").select("id", F.least("c", "far").alias("component"), F.col("component").alias("was")))
        changed = new.filter("component <> was").limit(1).count()
        drop_cut(label)
        label = new
        if not changed:
            return label.select("id", "component")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def verdicts(pairs: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``pairs`` (a, b) with a rule-based verdict: equal ticker or CIK says yes, different ones no, else null."""
    x, y = (facts.select(F.col(key).alias(e), F.col("ticker").alias(f"t_{e}"), F.col("cik").alias(f"c_{e}")) for e in ("a", "b"))
    same = (F.col("t_a") == F.col("t_b")) | (F.col("c_a") == F.col("c_b"))
    other = (F.col("t_a") != F.col("t_b")) | (F.col("c_a") != F.col("c_b"))
    return pairs.join(x, "a").join(y, "b").withColumn("same", F.when(same, True).when(other, False)).drop("t_a", "t_b", "c_a", "c_b")


def gated_groups(confirmed: DataFrame, members: DataFrame, max_group: int = 10) -> DataFrame:
    """(component, size, links, status): flagged when too large, needs_confirmation when a pair is missing, else ready."""
    once = confirmed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    links = once.join(members.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    status = F.when(F.col("size") > max_group, "flagged").when(F.col("links") < F.col("size") * (F.col("size") - 1) / 2, "needs_confirmation").otherwise("ready")
    return sizes.join(links, "component").select("component", "size", "links", status.alias("status"))


def missing_pairs(confirmed: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, a, b) of the pairs that groups in need of confirmation lack; such groups are small by definition."""
    open_ = members.join(groups.filter("status = 'needs_confirmation'").select("component"), "component")
    once = confirmed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = open_.withColumnRenamed("id", "a").join(open_.withColumnRenamed("id", "b"), "component").filter("a < b")
    return pairs.join(once, ["a", "b"], "left_anti").select("component", "a", "b")


#: Names that must, and must not, end up in one group.
MUST_MERGE = [
    ["Amazon.com, Inc.", "Amazon", "Amazon, Inc.", "Amazon.com"], ["Microsoft Corporation", "Microsoft"], ["NVIDIA Corporation", "NVIDIA"],
    ["Apple Inc.", "Apple Inc", "Apple"], ["Alphabet Inc.", "Alphabet"], ["Google Inc.", "Google"],
]
MUST_NOT_MERGE = [["PayPal", "PayPal (Europe)"], ["PayPal", "PayPal Pte. Ltd."], ["Microsoft Corporation", "Microsoft Mobile Oy"], ["Microsoft Corporation", "Microsoft's Bing"]]


def ground_truth(groups: DataFrame, together: list[list[str]], apart: list[list[str]]) -> DataFrame:
    """(check, passed): one row per expected merge and per forbidden pair, for ``groups`` (component, name)."""
    spark = groups.sparkSession
    wanted = spark.createDataFrame([(f"merge {i}", x, True) for i, x in enumerate(together)] + [(f"apart {i}", x, False) for i, x in enumerate(apart)], "check string, names array<string>, together boolean")
    hits = wanted.withColumn("name", F.explode("names")).join(groups, "name").groupBy("check", "component").agg(F.count_distinct("name").alias("n"))
    best = hits.groupBy("check").agg(F.max("n").alias("n"))
    passed = F.when(F.col("together"), F.coalesce("n", F.lit(0)) == F.size("names")).otherwise(F.coalesce("n", F.lit(0)) < 2)
    return wanted.join(best, "check", "left").select("check", passed.alias("passed"))


def truthy_count(properties: Column) -> Column:
    """Number of properties that are neither null nor ``''`` and whose key has no leading ``__``."""
    return F.coalesce(F.size(F.map_filter(properties, lambda k, v: ~k.startswith("__") & v.isNotNull() & (v != ""))), F.lit(0))
