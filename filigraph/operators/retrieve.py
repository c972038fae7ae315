"""Vector retrieval: exact cosine top-k for one or many query vectors, and what the graph knows around the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.tables import cut


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sound_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """The rows whose vector has ``width`` finite numbers that are not all zero."""
    v = F.col(vector)
    return df.filter((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def vector_topk(df: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(key, cosine, score): the k rows nearest to the one vector of ``query`` (column ``q``), ties by key.

    The query is a single row, so joining it is no product of two tables; the top k is taken per partition first. More
    than one row is an error: :func:`vectors_topk` answers many.
    """
    one = query.limit(2).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one query vector"))).otherwise(F.first("q")).alias("q"))
    scored = df.crossJoin(F.broadcast(one)).select(key, cosine(F.col(vector), F.col("q")).alias("cosine"))
    top = scored.filter("cosine is not null").orderBy(F.desc("cosine"), key).limit(k)
    return top.select(key, F.round("cosine", 6).alias("cosine"), F.round((F.col("cosine") + 1) / 2, 6).alias("score"))


#: Rows and query vectors of a block, and query vectors that are multiplied at a time.
ROWS, QUERIES, SLICE = 64_000, 32_000, 64


def vectors_topk(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query_key, key, cosine, score, place): for every vector of ``queries`` (query_key, ``q``) the k nearest rows of ``df``, ties by key.

    Rows and queries are dealt to blocks by hash and every two blocks meet in one group by an equi-join; a group keeps the
    k best per query, and those are merged. Cosines that agree to 12 digits are ties. Vectors with a null, NaN or infinite
    number or of length zero take no part, and only vectors of equal width are compared. Keys are unique in each table.
    """
    sound = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter(sound(F.col("v"))).withColumn("w", F.size("v"))
    asked = cut(queries.select(F.col(query_key).alias("k"), F.col("q").alias("v")).filter(sound(F.col("v"))).withColumn("w", F.size("v")))
    blocks, slices = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    deal = lambda frame, own, n, other, m: frame.withColumn(own, F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(rows, "b", blocks, "s", slices).groupBy("w", "b", "s"), deal(asked, "s", slices, "b", blocks).groupBy("w", "b", "s")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(x) or not len(y):
            return
        x = x.sort_values("k", ignore_index=True)  # so that places are in the order of keys
        unit = lambda v: (m := np.stack(v.to_numpy()).astype("float64")) / np.sqrt((m * m).sum(axis=1))[:, None]
        r, q, n = unit(x["v"]), unit(y["v"]), min(k, len(x))
        for at in range(0, len(y), SLICE):
            c = np.round(q[at : at + SLICE] @ r.T, 12)
            least = np.partition(c, len(x) - n, axis=1)[:, len(x) - n]
            i, j = np.nonzero(c >= least[:, None])
            order = np.lexsort((j, -c[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < n
            i, j = i[first], j[first]
            yield pd.DataFrame({"a": y["k"].to_numpy()[at + i], "k": x["k"].to_numpy()[j], "cosine": c[i, j]})

    kinds = f"a {queries.schema[query_key].dataType.simpleString()}, k {df.schema[key].dataType.simpleString()}, cosine double"
    found = left.cogroup(right).applyInPandas(lambda x, y: pd.concat([pd.DataFrame({"a": y["k"][:0], "k": x["k"][:0], "cosine": np.zeros(0)}), *best(x, y)]), kinds)
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "k"))).filter(F.col("place") <= k)
    return top.select(F.col("a").alias(query_key), F.col("k").alias(key), F.round("cosine", 6).alias("cosine"), F.round((F.col("cosine") + 1) / 2, 6).alias("score"), "place")


def similar_rows(df: DataFrame, key: str, vector: str, seed: Column, k: int) -> DataFrame:
    """The k rows most similar to the row where ``seed`` holds, that row left out after k + 1 are taken."""
    query = df.filter(seed).select(F.col(vector).alias("q"), F.col(key).alias("_seed"))
    hits = vector_topk(df, key, vector, query, k + 1)
    return hits.join(F.broadcast(query.select(F.col("_seed").alias(key))), key, "left_anti").orderBy(F.desc("cosine"), key).limit(k)


def adjacent(hits: DataFrame, chunks: DataFrame, next_chunk: DataFrame, key: str, text: str) -> DataFrame:
    """``hits`` with the texts before and after each chunk, ``''`` where there is none."""
    words = chunks.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    before = next_chunk.join(words, F.col("src") == F.col("_k")).select(F.col("dst").alias(key), F.col("_t").alias("prev_text"))
    after = next_chunk.join(words, F.col("dst") == F.col("_k")).select(F.col("src").alias(key), F.col("_t").alias("next_text"))
    joined = hits.join(before, key, "left").join(after, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("prev_text", "next_text")})
