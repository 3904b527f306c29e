"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("SIEVEKIT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_tokens(texts: list[str | None], vocabulary: bytes) -> list[int]:
    """Tokens of each text; 0 for None and empty texts.  Special tokens are ordinary text."""
    enc = encoding(vocabulary)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def with_token_counts(df: DataFrame, text: str = "text", into: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the token count of whole ``text`` instead of it.  The driver reads the vocabulary and sends it with the job."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # a file of fixed size

    def run(batches):
        for b in batches:
            n = pa.array(count_tokens(b.column(text).to_pylist(), vocabulary.value), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, into])

    return df.select(*keep, F.col(text)).mapInArrow(run, f"{schema}, {into} long" if schema else f"{into} long")
