"""Encoders and language models as pluggable providers, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import struct
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import validate_dim
from .errors import ENCODER, MemoryError_


class Encoder(Protocol):
    dim: int

    def encode(self, text: str) -> list[float]: ...


class LanguageModel(Protocol):
    def keywords(self, text: str) -> list[str]: ...

    def consolidate(self, prompt: str) -> list[dict]: ...

    def distill(self, prompt: str) -> dict: ...

    def crystallize(self, prompt: str) -> list[dict]: ...


class HashEncoder:
    """A vector from the digests of a text's words: equal texts have equal vectors, shared words bring texts closer."""

    def __init__(self, dim: int = 64):
        self.dim = validate_dim(dim)

    def encode(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for word in text.lower().split():
            raw = hashlib.sha256(word.encode()).digest()
            place, sign = struct.unpack("<Ib", raw[:5])
            out[place % self.dim] += 1.0 if sign >= 0 else -1.0
        return out


class OfflineModel:
    """Keywords are the longest words; groups, profiles and capabilities are what the caller put in."""

    def __init__(self, groups: list[dict] | None = None, profile: dict | None = None, capabilities: list[dict] | None = None, most: int = 8):
        self._groups, self._profile, self._capabilities, self._most = groups or [], profile or {}, capabilities or [], most

    def keywords(self, text: str) -> list[str]:
        words = dict.fromkeys(w.strip(".,;:!?\"'()").lower() for w in text.split())
        return sorted((w for w in words if len(w) > 3), key=lambda w: (-len(w), w))[: self._most]

    def consolidate(self, prompt: str) -> list[dict]:
        return self._groups

    def distill(self, prompt: str) -> dict:
        return self._profile

    def crystallize(self, prompt: str) -> list[dict]:
        return self._capabilities


def encode_column(encoder: Encoder, text: Column) -> Column:
    """Vectors of a text column, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _checked(encoder, t or ""))

    return encode(text)


def _checked(encoder: Encoder, text: str) -> list[float]:
    found = encoder.encode(text)
    if len(found) != encoder.dim:
        raise MemoryError_(ENCODER, f"the encoder gave {len(found)} values instead of {encoder.dim}")
    return found
