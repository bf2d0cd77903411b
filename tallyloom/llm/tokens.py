"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut a text before merging. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(raw: bytes):
    """The tokenizer, made once per Python worker."""
    import tiktoken

    store = sys.modules.setdefault("_tallyloom_tokenizers", types.ModuleType("_tallyloom_tokenizers")).__dict__.setdefault("made", {})
    key = hash(raw)
    if key not in store:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        store[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return store[key]


def with_tokens(df: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of ``text``: 0 for an empty text, null for null.

    ``vocabulary`` is a rank file (base64 of the token and its rank per line, about 1 MB). It is read on the driver and
    broadcast, so the executors need no copy of it. Strings of special tokens in a text are ordinary text.
    """
    with open(vocabulary, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(held.value).encode_ordinary
        for s in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in s], dtype="Int64")

    return df.withColumn(name, count(text))
