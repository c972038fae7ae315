"""Mapping free-entered values to a canonical list: symmetric deletes, weighted edit distance, misses reported.

The dictionary holds, of every word of a reference and of all its sorted words joined, every form that deleting up to
``max_edits`` letters gives. Typed words are expanded the same way, so a lookup is an equi-join on deleted forms,
broadcast only when the dictionary's counted size allows it and shuffled otherwise; shortened words have keys of their
own. All pairs of words that the comparison accepts are found, so one word of a typed name leads to all of its candidates. Candidates are verified by
Damerau–Levenshtein, must not say anything that the reference does not (a subsidiary or namesake does), must take the
words that tell the reference from others, and are ranked by weighted distance, then reference frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph.llm import names
from filigraph.tables import cut, small_enough, spread

UNMATCHED = "UNMATCHED"
#: A dictionary of at most so many rows (some 50 bytes each) is broadcast, a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: The distance of a word that shortens another.
SHORTENED = 0.3
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i + r * 0.5) for r, line in enumerate(_KEYS) for i, c in enumerate(line)}


@lru_cache(maxsize=200_000)
def weighted_distance(a: str, b: str) -> float:
    """Damerau–Levenshtein with cheaper slips: doubled letters, swapped neighbours, adjacent keys, vowel for vowel."""

    def change(x: str, y: str) -> float:
        if x == y:
            return 0.0
        p, q = _PLACE.get(x), _PLACE.get(y)
        near = p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.1
        return 0.6 if near or (x in "aeiou" and y in "aeiou") else 1.0

    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            drop = 0.5 if i > 1 and a[i - 2] == x else 0.9
            add = 0.5 if j > 1 and b[j - 2] == y else 0.9
            best = min(rows[i - 1][j] + drop, row[j - 1] + add, rows[i - 1][j - 1] + change(x, y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 0.6)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def edits_allowed(a: str, b: str, max_edits: int) -> int:
    """How many edits may part two words: none in words of two letters or less, one in words of six or less."""
    short = min(len(a), len(b))
    return max_edits if short > 6 else min(max_edits, 1) if short > 2 else 0


def deleted_forms(df: DataFrame, word: str, max_edits: int, probe: bool) -> DataFrame:
    """``df`` exploded by ``form``: the word and what deleting up to ``max_edits`` letters gives (one for short words).

    Long words have too many of these; they give their segments, or with ``probe`` the places where a segment of a word
    within two edits may stand, which misses nothing either.
    """

    @F.pandas_udf("array<string>")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            out = []
            for w in words:
                keys = names.deletes(w, max_edits if len(w) > 6 else min(1, max_edits)) if len(w) <= names.LONG + 4 else set()
                out.append(sorted(keys | {"#" + x for x in names.segments(w, probe)} if len(w) > names.LONG else keys))
            yield pd.Series(out, dtype=object)

    return df.withColumn("form", F.explode(forms(F.col(word))))


def near_words(typed: DataFrame, reference: DataFrame, max_edits: int) -> DataFrame:
    """(word, ref_word) of typed and reference words (column ``word`` of each) within ``max_edits`` edits; at most two."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([names.osa(x, y, max_edits) <= edits_allowed(x, y, max_edits) for x, y in zip(a, b, strict=True)], dtype=bool)

    dictionary = deleted_forms(reference.select(F.col("word").alias("ref_word")).filter("ref_word <> ''").distinct(), "ref_word", max_edits, False)
    looked_up = deleted_forms(spread(typed.select("word").filter("word <> ''").distinct()), "word", max_edits, True)
    if small_enough(dictionary, BROADCAST_ROWS):
        dictionary = F.broadcast(dictionary)
    return looked_up.join(dictionary, "form").select("word", "ref_word").distinct().filter(near("word", "ref_word"))


def shortening_keys(word: str, probe: bool) -> set[str]:
    """Keys of a reference word, or with ``probe`` of a typed one; a typed word that shortens a reference, with a slip too, shares one.

    First letter, last sound and up to two inner letters for a word without inner letters; beginnings with up to one letter
    left out for a word cut off (of longer words two stretches, of which one slip leaves one as it is, moved by one at most).
    """
    inner, last = (word[1:-1], word[-1:]) if probe else ((x := word.rstrip("aeiou"))[1:-1], x[-1:])
    firsts = {inner[:2]} if probe else {"", *inner, *(c + d for i, c in enumerate(inner[:-1]) for d in set(inner[i + 1 :]))}
    keys = {f"{word[:1]}{last}:{x}" for x in firsts}
    for n in [len(word)] if probe else range(1, min(len(word) - 1, names.LONG + 5) + 1):
        keys |= {"~" + x for x in names.deletes(word[:n], 1)} if n <= names.LONG + 5 else set()
    if len(word) > names.LONG + 4:
        keys |= {"<" + word[:7], *(">" + word[12 + move : 19 + move] for move in ([0] if probe else (-1, 0, 1)))}
    return keys


def shortened_words(typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(word, ref_word) of typed words that shorten reference words (column ``word`` of each), with a slip too if cut off."""

    def keyed(probe: bool) -> Callable[[Column], Column]:
        @F.pandas_udf("array<string>")
        def keys(words: pd.Series) -> pd.Series:
            return pd.Series([sorted(shortening_keys(w, probe)) for w in words], dtype=object)

        return keys

    @F.pandas_udf("boolean")
    def shortens(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([names.shortens(x, y) or names.shortens_nearly(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    dictionary = reference.select(F.col("word").alias("ref_word")).filter("length(ref_word) > 3").distinct().select("ref_word", F.explode(keyed(False)("ref_word")).alias("form"))
    looked_up = spread(typed.select("word").filter("length(word) > 1").distinct()).select("word", F.explode(keyed(True)("word")).alias("form"))
    if small_enough(dictionary, BROADCAST_ROWS):
        dictionary = F.broadcast(dictionary)
    pairs = looked_up.join(dictionary, "form").filter("length(ref_word) > length(word) + 1").select("word", "ref_word").distinct()
    return pairs.filter(shortens("word", "ref_word"))


def typed_distance(typed: names.Said, ref: names.Said, weights: list[float], max_edits: int) -> float | None:
    """How far a typed name is from a reference that says all it says; None if it says something else or too little.

    Every typed word takes a reference word for itself: an equal one, else the nearest within ``max_edits`` edits, else
    one that it shortens. ``weights`` say how much each reference word tells; what is taken must include the most telling
    one and two fifths of the whole. Words typed together or apart are compared as one word.
    """
    if typed[2] and typed[2] != ref[2]:
        return None
    left, total, got, rest = dict(zip(ref[0], weights, strict=True)), 0.0, [], []
    for w in typed[0]:
        if w in left:
            got.append(left.pop(w))
        else:
            rest.append(w)
    for w in rest:
        found = min(((weighted_distance(w, x), x) for x in left if names.osa(w, x, max_edits) <= edits_allowed(w, x, max_edits)), default=None)
        found = found or next(((SHORTENED, x) for x in left if names.shortens(w, x)), None) or next(((SHORTENED + 1, x) for x in left if names.shortens_nearly(w, x)), None)
        if found is None:
            break
        total += found[0]
        got.append(left.pop(found[1]))
    else:
        if got and max(got) >= max(weights) and sum(got) >= 0.4 * sum(weights):
            return total
    a, b = "".join(typed[0]), "".join(ref[0])
    return 0.5 + weighted_distance(a, b) if len(b) > 6 and names.osa(a, b, max_edits) <= max_edits else None


def _blank(x: str) -> F.Column:
    return F.coalesce(F.trim(F.regexp_replace(F.col(x), r"[\s ]+", " ")), F.lit(""))


def named_companies(entries: DataFrame, listed: DataFrame, max_edits: int) -> DataFrame:
    """(typed_name, by_name): the listed company that each of the ``entries`` (typed_name, n) names, if there is one."""
    joined = F.concat_ws("", "words")
    spelt = cut(names.parsed(spread(entries.select("typed_name").distinct().filter("typed_name <> ''")), "typed_name", F.lit("C")).filter(F.size("words") > 0))
    known = names.parsed(listed.filter("name is not null").select("companyid", "name"), "name", F.lit("C")).filter(F.size("words") > 0).drop("name")
    known = cut(known)
    terms = cut(known.select("companyid", F.explode("words").alias("ref_word")))
    counts = terms.groupBy("ref_word").agg(F.count(F.lit(1)).alias("n"))
    held = known.select("companyid", F.explode(F.array_distinct(F.array_append("words", joined))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    asked = cut(spelt.select("typed_name", F.explode("words").alias("word")))
    listed_words = counts.select(F.col("ref_word").alias("word"))
    met_words = cut(near_words(asked, listed_words, max_edits).union(shortened_words(asked, listed_words)).distinct().join(counts, "ref_word"))
    # every typed word must be met in one of these ways, so the one that leads to the fewest references misses none
    leads = asked.join(met_words.groupBy("word").agg(F.sum("n").alias("leads")), "word", "left")
    ways = leads.groupBy("typed_name").agg(F.min(F.struct("leads", "word")).alias("w"), F.bool_and(F.col("leads").isNotNull()).alias("all_met")).filter("all_met").select("typed_name", "w.word")
    by_word = ways.join(met_words, "word").join(terms, "ref_word").select("typed_name", "companyid")
    # names typed together or apart are compared as one word
    one, ones = spelt.select("typed_name", joined.alias("word")), known.select("companyid", joined.alias("ref_word"))
    as_one = cut(near_words(one, ones.select(F.col("ref_word").alias("word")), max_edits))
    names_met = by_word.union(one.join(as_one, "word").join(ones, "ref_word").select("typed_name", "companyid")).distinct()
    size = known.count()
    weight = F.log(1 + F.lit(float(size)) / F.col("held"))
    weighed = known.select("companyid", F.explode("words").alias("word")).join(held, "word").groupBy("companyid").agg(F.map_from_entries(F.collect_list(F.struct("word", weight.alias("w")))).alias("weights"))
    full = known.join(weighed, "companyid").select("companyid", F.struct("words", "initials", "legal").alias("ref"), F.transform("words", lambda w: F.col("weights")[w]).alias("weights"))

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, weights in batches:
            sides = [zip(map(tuple, x["words"]), map(tuple, x["initials"]), x["legal"], strict=True) for x in (a, b)]
            yield pd.Series([typed_distance(x, y, list(w), max_edits) for x, y, w in zip(*sides, weights, strict=True)], dtype="float64")

    met = names_met.join(spelt.select("typed_name", F.struct("words", "initials", "legal").alias("said")), "typed_name").join(full, "companyid")
    found = cut(spread(met).withColumn("distance", distance("said", "ref", "weights")).filter("distance is not null and not isnan(distance)").select("typed_name", "companyid", "distance"))
    # how often a reference is named as it is listed decides between equally distant ones
    seen = found.filter("distance = 0").join(entries.groupBy("typed_name").agg(F.sum("n").alias("n")), "typed_name").groupBy("companyid").agg(F.sum("n").alias("seen"))
    order = F.struct("distance", (-F.coalesce("seen", F.lit(0))).alias("seen"), "companyid")
    return found.join(seen, "companyid", "left").groupBy("typed_name").agg(F.min(order).alias("best")).select("typed_name", F.col("best.companyid").alias("by_name"))


def matched_companies(competitors: DataFrame, companies: DataFrame, max_edits: int = 2) -> DataFrame:
    """(row_id, companyid): the listed company that a row means, else ``UNMATCHED``.

    Rows whose targetcompanyid is exactly a listed companyid are no free entry and give no row. A typed id is read as
    company number, CIK, ticker or CUSIP whatever marks, zeros or case it has; where it means nothing, the typed name
    decides. Distinct entries are resolved once and joined back to all rows; null, blank and vague entries are
    unmatched. Ties go to the smaller distance, then the more frequent reference, then the smaller companyid.
    """
    listed = companies.select("companyid", "name", "ticker", "cik", "cusip").filter("companyid is not null").dropDuplicates(["companyid"])
    exact = listed.select(F.col("companyid").alias("targetcompanyid"))
    rows = competitors.select("row_id", "targetcompanyid", "targetcompanyname").join(exact, "targetcompanyid", "left_anti")
    rows = rows.withColumn("typed_id", _blank("targetcompanyid")).withColumn("typed_name", _blank("targetcompanyname"))
    blank = (F.col("typed_id") == "") & (F.col("typed_name") == "")
    entries = cut(rows.filter(~blank).groupBy("typed_id", "typed_name").agg(F.count(F.lit(1)).alias("n")))

    number = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    alias = F.array(
        F.concat(F.lit("#"), number(F.regexp_extract("companyid", r"(\d+)\s*$", 1))), F.concat(F.lit("n"), number("cik")), F.concat(F.lit("t"), F.lower("ticker")), F.concat(F.lit("n"), number("cusip")), F.concat(F.lit("t"), F.lower("cusip"))
    )
    aliases = listed.select("companyid", F.explode(F.array_distinct(F.array_compact(alias))).alias("code")).filter("length(code) > 1").groupBy("code").agg(F.min("companyid").alias("by_id"), F.count_distinct("companyid").alias("k")).filter("k = 1").drop("k")
    low = F.lower("typed_id")
    code = (
        F.when(low.rlike(r"^\W*c[o]?[\W_]*\d+\W*$"), F.concat(F.lit("#"), number(F.regexp_extract(low, r"(\d+)\W*$", 1))))
        .when(low.rlike(r"^\W*(cik)?[\W_]*\d+\W*$"), F.concat(F.lit("n"), number(F.regexp_extract(low, r"(\d+)\W*$", 1))))
        .otherwise(F.concat(F.lit("t"), F.regexp_replace(low, r"^\W+|\W+$", "")))
    )
    by_id = entries.select("typed_id").distinct().filter("typed_id <> ''").withColumn("code", code).join(F.broadcast(aliases) if small_enough(aliases, BROADCAST_ROWS) else aliases, "code").select("typed_id", "by_id")

    by_name = named_companies(entries, listed, max_edits)

    # a typed name may be a ticker
    symbol = entries.select("typed_name").distinct().filter("typed_name <> ''").withColumn("code", F.concat(F.lit("t"), F.lower("typed_name")))
    by_symbol = symbol.join(aliases, "code").select("typed_name", F.col("by_id").alias("by_symbol"))
    resolved = entries.join(by_id, "typed_id", "left").join(by_symbol, "typed_name", "left").join(by_name, "typed_name", "left").select("typed_id", "typed_name", F.coalesce("by_id", "by_symbol", "by_name").alias("companyid")).filter("companyid is not null")
    return rows.join(resolved, ["typed_id", "typed_name"], "left").select("row_id", F.coalesce("companyid", F.lit(UNMATCHED)).alias("companyid"))
