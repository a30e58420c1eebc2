"""Counting engines: bytes over four as a Column, or a count of each text in an Arrow UDF.

The precise engines of the package read a BPE vocabulary.  ``register`` adds an engine of
any other kind: a name, a label and a function from a text to its number of tokens.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENGINES, MARGIN
from . import columns as C

#: Where the vocabularies of the precise engines are: set with ``configure``, or from the environment.
_paths: dict[str, str] = {}
_registered: dict[str, Engine] = {}

# The patterns by which rank files split text: that of the o200k encoding, which is
# the engine "openai"'s, and the older one of byte-level vocabularies.
O200K = "|".join((
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"\p{N}{1,3}",
    r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
    r"\s*[\r\n]+",
    r"\s+(?!\S)",
    r"\s+",
))
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERNS = {"openai": O200K}


@dataclass(frozen=True)
class Engine:
    """``path``: its vocabulary file; or ``count``: its own function."""

    id: str
    label_key: str
    path: str | None = None
    count: Callable[[str], int] | None = None

    def counter(self) -> Callable[[str], int]:
        if self.count is not None:
            return self.count
        encoded = encoding(self.path, PATTERNS.get(self.id, BYTE_LEVEL)).encode_ordinary
        return lambda text: len(encoded(text))


def configure(engine: str, path: str | None) -> None:
    """Names the vocabulary file of a precise engine (rank file or Tekken JSON)."""
    if path is None:
        _paths.pop(engine, None)
    else:
        _paths[engine] = path


def register(id: str, count: Callable[[str], int], label_key: str | None = None) -> Engine:
    """Adds an engine, or puts another in its place; ``count`` goes to the workers with the tasks."""
    if id == "approx":
        raise ValueError("the approximation can't be replaced")
    _registered[id] = Engine(id, label_key or f"tokenizer.{id}", count=count)
    return _registered[id]


def unregister(id: str) -> None:
    _registered.pop(id, None)


def _vocabulary(engine: str) -> str | None:
    return _paths.get(engine) or os.environ.get(f"LODESTACK_{engine.upper()}_VOCABULARY")


def available(engine: str) -> bool:
    path = _vocabulary(engine)
    return engine == "approx" or engine in _registered or bool(path and os.path.isfile(path))


def resolve(engine: str) -> Engine:
    """An unknown or unavailable engine falls back to the approximation."""
    if engine in _registered:
        return _registered[engine]
    known = engine if engine in ENGINES and available(engine) else "approx"
    return Engine(known, f"tokenizer.{known}", _vocabulary(known))


def list_engines() -> list[Engine]:
    """In a fixed order, the approximation first, those registered last."""
    return [_registered.get(e, Engine(e, f"tokenizer.{e}")) for e in (*ENGINES, *(e for e in _registered if e not in ENGINES))]


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = BYTE_LEVEL):
    """The vocabulary as an encoder, loaded once per worker; ``pattern`` is that of a rank file, Tekken JSON has its own."""
    import tiktoken

    with open(path, "rb") as f:
        raw = f.read()
    if raw.lstrip()[:1] == b"{":
        data = json.loads(raw)
        pattern, size = data["config"]["pattern"], data["config"]["default_vocab_size"] - data["config"]["default_num_special_tokens"]
        ranks = {base64.b64decode(x["token_bytes"]): x["rank"] for x in data["vocab"][:size]}
    else:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, engine: Engine) -> Column:
    if engine.id == "approx":
        return C.approx_tokens(F.octet_length(F.coalesce(text, F.lit(""))))

    def counted(texts: pd.Series) -> pd.Series:
        count = engine.counter()
        return texts.map(lambda x: count(x or ""))

    return F.pandas_udf(counted, "long")(text)


def precise_estimate(rows: pd.DataFrame, engine: Engine, margin: float = MARGIN) -> pd.DataFrame:
    """Text counted once; the header, given in two halves around the numbers, until it settles."""
    import math

    count = engine.counter()
    out = []
    for text, a, b, c in zip(rows["text"], rows["before"], rows["between"], rows["after"], strict=True):
        body, raw = count(text or ""), len((text or "").encode())
        tokens, margined = body, math.ceil(body * (1.0 + margin))
        for _ in range(20):
            n = count(f"{a}{tokens}{b}{margined}{c}\n\n") + body
            m = math.ceil(n * (1.0 + margin))
            if (n, m) == (tokens, margined):
                break
            tokens, margined = n, m
        out.append((len(f"{a}{tokens}{b}{margined}{c}\n\n".encode()) + raw, tokens, margined))
    return pd.DataFrame(out, columns=["bytes_utf8", "tokens_estimated", "tokens_with_margin"])
