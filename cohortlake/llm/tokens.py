"""Sizes of texts in tokens of a public tokenizer, measured inside tasks over whole texts."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file and split pattern; the files stay where they are installed.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once, about: a longer text is cut before a blank that follows a letter or sign, where this pattern never joins.
STRETCH = 100_000
_CUT = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = RANKS) -> int:
    if not text:
        return 0
    enc, n, at = encoding(path), 0, 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH)
        end = cut.end() if cut else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def with_tokens(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """``documents`` with n_tokens BIGINT; null and empty texts have 0. The text column is dropped."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no rank file at {path}")
    documents.sparkSession.sparkContext.addFile(path)  # for executors that have no such file; sent once
    rest = [f for f in documents.schema.fields if f.name not in ("text", "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", n_tokens bigint"
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            out["n_tokens"] = [count_tokens(t, path) for t in pdf["text"]]
            yield out

    return documents.select(*[F.col(f"`{n}`") for n in names], "text").mapInPandas(run, schema)
