"""Lengths of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary's file, as ranks; another one is given as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict[int, object] = {}


def encoding(data: bytes):
    """One encoder a process."""
    key = hash(data)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def with_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text and what else a caller needs -> the same without text, with n_tokens (0 for null or empty texts).

    The vocabulary is read on the driver and sent with the tasks; its size is fixed, below a megabyte."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    rest = [c for c in docs.columns if c not in ("text", "n_tokens")]
    out = T.StructType([*docs.select(*rest).schema.fields, T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(data)
        for pdf in batches:
            yield pdf[rest].assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in pdf.text])

    return docs.select(*rest, F.col("text")).mapInPandas(run, out)
