"""Texts to chunks: fixed-size windows, chains, hashed embeddings and links by mention."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_text(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, whole_words: bool = False) -> DataFrame:
    """(key, index, chunk): windows of ``size`` characters that overlap, in order; null texts give none.

    With ``whole_words`` a window that ends inside a word is cut back to its last blank.
    """
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = df.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("index", "_s"))
    part = F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size))
    if whole_words:
        inside = (F.col("_s") + size < F.length("_t")) & F.substring(F.col("_t"), F.col("_s") + size, F.lit(2)).rlike(r"^\w\w$")
        part = F.when(inside & part.rlike(r"\s"), F.regexp_replace(part, r"\s+\S*$", "")).otherwise(part)
    return rows.select(key, "index", part.alias("chunk"))


def chunk_chain(chunks: DataFrame, document: str, index: str, key: str) -> DataFrame:
    """(src, dst): each chunk and the next one of its document."""
    after = F.lead(key).over(Window.partitionBy(document).orderBy(index, key))
    return chunks.filter(F.col(document).isNotNull()).select(F.col(key).alias("src"), after.alias("dst")).filter("dst is not null")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic bag-of-words vector of unit length: words are hashed to ``width`` signed buckets, in one Arrow pass."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            words = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), r"[^\p{L}\p{N}]+", " ")) if len(texts) else pa.array([], pa.large_list(pa.large_string()))
            flat = pc.list_flatten(words)
            known = pc.dictionary_encode(flat)
            if isinstance(known, pa.ChunkedArray):
                known = known.combine_chunks()
            codes = np.array([zlib.crc32(w.encode()) for w in known.dictionary.to_pylist()], np.int64)
            codes = codes[known.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
            row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            sign = np.where((codes >> 16) % 2 == 0, 1.0, -1.0)
            sums = np.bincount((row * width + codes % width)[full], weights=sign[full], minlength=len(texts) * width).astype(np.float64).reshape(len(texts), width)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            sums = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)
            yield pd.Series([None if t is None else v for t, v in zip(texts, sums, strict=True)], dtype=object)

    return embed(text)


def normal_words(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text between single blanks, one before and after; ``' '`` if none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def mentions(chunks: DataFrame, key: str, text: str, names: DataFrame, name: str, name_key: str) -> DataFrame:
    """(src, dst): names whose words a text holds one after the other, whatever stands between words.

    A text and a name meet by the word of the name that the fewest texts hold, and a candidate is verified in the text,
    so no pair of all texts and all names is ever formed. Null names and names without a letter or digit are in no text.
    """
    wanted = names.filter(F.col(name).isNotNull()).select(F.col(name_key).alias("src"), normal_words(F.col(name)).alias("_name")).filter("_name <> ' '")
    parts = wanted.select("src", "_name", F.explode(F.array_distinct(F.split(F.trim("_name"), " "))).alias("_word"))
    texts = chunks.select(F.col(key).alias("dst"), normal_words(F.col(text)).alias("_text"))
    words = texts.select("dst", F.explode(F.array_distinct(F.split(F.trim("_text"), " "))).alias("_word")).join(parts.select("_word").distinct(), "_word", "left_semi")
    held = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_held"))
    rarest = parts.join(held, "_word", "left").groupBy("src", "_name").agg(F.min_by("_word", F.struct(F.coalesce("_held", F.lit(0)), "_word")).alias("_word"))
    hits = words.join(rarest, "_word").join(texts, "dst")
    return hits.filter(F.contains("_text", "_name")).select("src", "dst").distinct()
