"""Keyword retrieval over postings: BM25, boolean and fuzzy terms, and fusion with vector hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: A query of at most so many terms is broadcast, a longer one (an expanded one, say) is shuffled.
MOST_TERMS = 10_000


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): the lower-case runs of letters and digits of each text, repeats included."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    return df.select(key, F.explode(words).alias("term")).filter("term <> ''")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): term frequency and document length, counted without a join."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = df.select(key, words.alias("_w")).select(key, F.size("_w").alias("length"), F.explode("_w").alias("term"))
    return rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, score) of the rows with at least one of the terms of ``query``, by Okapi BM25."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    wanted = F.array(*(F.lit(q.lower()) for q in query))
    # lengths and frequencies of the wanted terms only: nothing else is exploded
    rows = df.filter(F.col(text).isNotNull()).select(key, words.alias("_w"))
    rows = rows.select(key, F.size("_w").alias("length"), F.filter("_w", lambda w: F.array_contains(wanted, w)).alias("_w"))
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))
    tf = rows.select(key, "length", F.explode("_w").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df_), "term").crossJoin(F.broadcast(total))  # one row per query term; one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return x.groupBy(key).agg(F.sum(part).alias("score"))


def boolean(df: DataFrame, key: str, text: str, must: list[str] = (), any_of: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """(key) of the rows whose words hold all of ``must``, one of ``any_of`` if given, and none of ``must_not``."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    rows = df.withColumn("_w", words)
    for q in must:
        rows = rows.filter(F.array_contains("_w", q.lower()))
    if any_of:
        rows = rows.filter(F.arrays_overlap("_w", F.array(*(F.lit(q.lower()) for q in any_of))))
    for q in must_not:
        rows = rows.filter(~F.array_contains("_w", q.lower()))
    return rows.select(key)


def bm25_postings(index: DataFrame, key: str, query: DataFrame, documents: int, mean_length: float) -> DataFrame:
    """(key, score) by Okapi BM25 from stored :func:`postings`; ``query`` has the terms (column ``term``), each once.

    Only the postings of the query's terms are read beyond their key; ``documents`` and ``mean_length`` are those of the corpus.
    """
    hit = index.join(F.broadcast(query.select("term").distinct()), "term") if query.limit(MOST_TERMS + 1).count() <= MOST_TERMS else index.join(query.select("term").distinct(), "term")
    df_ = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return hit.join(df_, "term").groupBy(key).agg(F.sum(part).alias("score"))


def corpus_size(df: DataFrame, text: str) -> tuple[int, float]:
    """(documents, mean length in words) of the non-null texts."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    one = df.filter(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words)).alias("m")).first()
    return one["n"], one["m"] or 0.0


def near_terms(df: DataFrame, key: str, text: str, query: str, edits: int = 2) -> DataFrame:
    """(term, edits, n): words of the corpus within so many edits of ``query``, with the number of documents that hold them."""
    vocabulary = terms(df, key, text).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.withColumn("edits", F.levenshtein("term", F.lit(query), edits)).filter("edits >= 0").select("term", "edits", "n")


def fuzzy_search(df: DataFrame, key: str, text: str, query: str, edits: int = 2) -> DataFrame:
    """(key, score): documents ranked for every word of the corpus within so many edits of ``query``."""
    index = postings(df, key, text)
    near = index.select("term").distinct().filter(F.levenshtein("term", F.lit(query), edits) >= 0)
    return bm25_postings(index, key, near, *corpus_size(df, text))


def reciprocal_ranks(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """(key, score): hit lists (key, score) of bounded length fused by the sum of 1 / (constant + rank), ties by key."""
    ranked = [h.select(key, (1.0 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("score")) for h in lists]  # top-k lists only
    both = reduce(DataFrame.unionByName, ranked)
    return both.groupBy(key).agg(F.sum("score").alias("score")).orderBy(F.desc(F.round("score", 12)), key).limit(k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score): both hit lists (key, score), each scaled by its best score, the larger one where both hit."""
    scaled = lambda h: h.crossJoin(F.broadcast(h.agg(F.max("score").alias("_m")))).select(key, F.try_divide(F.col("score"), F.col("_m")).alias("score"))
    both = scaled(vector_hits).unionByName(scaled(keyword_hits))
    return both.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
