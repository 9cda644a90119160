"""A public byte-level BPE, loaded from a file of ranks that the driver reads and broadcasts."""

from __future__ import annotations

import base64

from pyspark import Broadcast
from pyspark.sql import SparkSession

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Cuts text before merging; nothing merges across.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_made: dict = {}


def share(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoding(raw: bytes, special: tuple[str, ...] = ()):
    """A tiktoken encoding, made once in a process; special strings get the ids after the ranks."""
    import tiktoken

    key = hash(raw), special
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={s: len(ranks) + k for k, s in enumerate(special)})
    return _made[key]
