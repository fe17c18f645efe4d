"""Token counts with a public tokenizer's ranks file; its path is a parameter."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that goes with byte-level BPE ranks of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}
#: bytes of a ranks file that is sent to the workers
MAX_RANKS = 64 << 20


def encoder(path: str = DEFAULT_RANKS, content: bytes | None = None):
    """The tokenizer of a ranks file (or of its content), loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str | None, path: str = DEFAULT_RANKS, content: bytes | None = None) -> int:
    """Tokens of a whole text."""
    return len(encoder(path, content).encode_ordinary(text)) if text else 0


def shipped(df: DataFrame, path: str = DEFAULT_RANKS):
    """The ranks file as a broadcast, so only the driver needs it; its size is checked."""
    if (size := os.path.getsize(path)) > MAX_RANKS:
        raise ValueError(f"{path} has {size} bytes; a ranks file has at most {MAX_RANKS}")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def with_tokens(df: DataFrame, keep: list[str], path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` columns and the token count of ``text`` (0 for a null or empty one)."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    ranks = shipped(df, path)

    def run(batches):
        for b in batches:
            n = pa.array([count_tokens(t, path, ranks.value) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "tokens"])

    return df.select(*keep, F.col("text")).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", tokens long")
