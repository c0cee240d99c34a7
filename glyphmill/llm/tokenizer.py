"""Token counts by a public tokenizer's rank file. The folder is a parameter; the file is shipped with the job and nothing of it is kept in the repository."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the driver's machine has its tokenizer files, and the one to use; executors get it with the job.
TOKENIZER_DIR, TOKENIZER_FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

#: Fixed value: the public split pattern of this byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer texts are encoded piece by piece, cut at white space after a non-space, which no token of this pattern crosses.
PIECE_CHARS = 20_000

_encoders: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("by_path", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS)
        while cut > 0 and (text[cut - 1].isspace() or cut + 1 >= len(text) or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str, path: str) -> int:
    enc = _encoder(path)
    return sum(len(enc.encode_ordinary(p)) for p in _pieces(text))


def token_count(text: Column, folder: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> Column:
    """Tokens of each whole text as bigint; null for null."""
    SparkSession.active().sparkContext.addFile(f"{folder}/{file}")

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = SparkFiles.get(file)
        for s in batches:
            yield s.map(lambda t: count_tokens(t, path), na_action="ignore").astype("Int64")

    return count(text)
