"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary file is looked up in the installed package unless a path is given.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str | None = None):  # noqa: ANN201
    """The byte-level BPE encoder of a rank file; one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text, read whole; zero for null."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, tokens) of each document with a text; cluster is a hash of the exact text."""
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    return rows.select("doc_id", "source", F.xxhash64("text").alias("cluster"), count_tokens(F.col("text"), path).alias("tokens")).filter("tokens > 0")
