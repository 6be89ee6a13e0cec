"""Exact token counts under a public byte-level BPE tokenizer, counted in Arrow batches where the texts are read."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Vocabulary file (ranks) on every machine of the cluster; a parameter of all operators that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts, cut where the splitting pattern always cuts, so that the count is the same.
PART = 200_000


@lru_cache(maxsize=4)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    """Cuts before a single blank between two other characters: no piece of the pattern reaches across it."""
    begin = 0
    while len(text) - begin > PART:
        cut = begin + PART
        while (cut := text.find(" ", cut)) > 0 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        if cut <= 0 or cut + 1 >= len(text):
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    if not text:
        return 0
    encode = _encoding(vocabulary).encode_ordinary
    return len(encode(text)) if len(text) <= PART else sum(len(encode(part)) for part in _parts(text))


def with_token_count(df: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its column ``text``, plus the number of tokens of ``text`` as ``out``; a null or empty text has 0."""
    kept = [f for f in df.schema.fields if f.name != text]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names = batch.schema.names
            counts = pa.array([count_tokens(t, vocabulary) for t in batch.column(names.index(text)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(f.name)) for f in kept] + [counts], names=[f.name for f in kept] + [out])

    return df.mapInArrow(batches, T.StructType([*kept, T.StructField(out, T.LongType())]))
