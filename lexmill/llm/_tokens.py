"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file: in `folder`, or the one that LEXMILL_TOKENIZERS names, or else that of the installed package of
    public tokenizers. Executors need the file under the same path."""
    folder = folder or os.environ.get("LEXMILL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        if spec is None:
            raise ValueError("name the folder of the vocabulary files, or set LEXMILL_TOKENIZERS")
        folder = os.path.dirname(spec.origin)
    return os.path.join(folder, name)


#: Byte-level BPE splits a text by this pattern first (fixed values of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of each text, whole; null and empty texts have none."""
    where = path or vocabulary()

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(where).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(x)) if x else 0 for x in part], dtype="int64")

    return count(text)
