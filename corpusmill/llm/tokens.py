"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusmill.functions.keys import opened, sealed
from corpusmill.functions.spread import spread

#: Folder of the vocabulary files on every executor, and the vocabulary used.
VOCABULARY_FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("corpusmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, columns: list[str], text: str = "text", folder: str = VOCABULARY_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of every row with n_tokens of its whole text; null and empty texts have none."""
    path = f"{folder}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if isinstance(t, str) and t else 0 for t in batch["__text"]]
            yield batch[columns].assign(n_tokens=pd.array(counts, dtype="int64"))

    types = dict(documents.dtypes)
    keys = [c for c in columns if types[c] in ("bigint", "int")]
    rows = documents.select(*[sealed(c).alias(c) if c in keys else c for c in columns], documents[text].alias("__text"))
    kinds = ", ".join(f"`{c}` {'bigint' if c in keys else types[c]}" for c in columns)
    return spread(rows).mapInPandas(count, f"{kinds}, n_tokens bigint").withColumns({c: opened(c) for c in keys})
