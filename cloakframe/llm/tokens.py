"""Sizes of texts in tokens of a public tokenizer, whose file stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary, one base64 token and its rank a line.
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(ranks: bytes):
    """The encoding of a rank file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(rows: DataFrame, key: list[str], text: str, path: str = DEFAULT) -> DataFrame:
    """(key, n_tokens) of every row; a null or empty text has 0 tokens.

    The vocabulary (under 1 MB, of fixed size) travels with the tasks.
    """
    ranks = Path(path).read_bytes()
    names = [*key, "n_tokens"]

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks)
        for b in batches:
            sizes = [0 if not t else len(enc.encode_ordinary(t)) for t in b.pop("_text")]
            b["n_tokens"] = sizes
            yield b[names]

    source = rows.select(*key, F.col(text).alias("_text"))
    kinds = dict(source.dtypes)
    return source.mapInPandas(count, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", n_tokens int")
