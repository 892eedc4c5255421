"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split of this vocabulary's family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict = {}


def encoding(path: str):
    """The tokenizer of a file of ranks, read once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and `tokens` (long): whole texts, null and empty ones are 0; the text itself is left behind."""
    kept = documents.select(*keep, "text")
    schema = kept.select(*keep).schema.add("tokens", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b.drop(columns="text")

    return kept.mapInPandas(run, schema)
