"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; every node needs the file at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a vocabulary file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    """The number of tokens of each text; 0 for null and empty ones."""
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def with_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(2).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
