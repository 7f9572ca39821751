"""What a model would do, as offline stand-ins that need no network and always answer alike."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, question: str, passages: list[str]) -> str: ...


class Verifier(Protocol):
    def __call__(self, claim: str, evidence: str) -> tuple[str, str]: ...


Scorer = Callable[[str, list[str]], list[tuple[int, float]]]


def term_set(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").lower()))


class HashingEmbedder:
    """Terms hashed to signed places, summed and scaled to length 1; an empty text is the zero vector."""

    model = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for term in _TERM.findall((text or "").lower()):
                h = xxhash.xxh64_intdigest(term)
                row[h % self.dimensions] += 1 if h >> 63 else -1
            row /= max(1e-12, float(np.sqrt(row @ row)))
        return out.tolist()


def embedded(text: Column, embedder: Embedder) -> Column:
    """The vectors of a text column, a batch at a time; the number of dimensions is checked."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        found = embedder.embed(["" if t is None else t for t in texts])
        if any(len(v) != embedder.dimensions for v in found):
            raise ValueError(f"the embedder gave other than {embedder.dimensions} dimensions")
        return pd.Series([np.asarray(v, np.float32) for v in found])

    return embed(text)


def overlap_scores(question: str, texts: list[str]) -> list[tuple[int, float]]:
    """The part of the question's terms that each text holds."""
    asked = term_set(question)
    return [(i, len(asked & term_set(t)) / max(1, len(asked))) for i, t in enumerate(texts)]


def extract(question: str, passages: list[str]) -> str:
    """The sentence of each passage that shares most terms with the question, cited by its ordinal."""
    asked, out = term_set(question), []
    for n, passage in enumerate(passages, 1):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", passage) if s.strip()]
        if sentences:
            best = max(sentences, key=lambda s: len(asked & term_set(s)))
            out.append(f"{best.strip().rstrip('.')} [{n}].")
    return " ".join(out)


def overlap_verdict(claim: str, evidence: str) -> tuple[str, str]:
    """Supported where the evidence holds at least six in ten of the claim's terms."""
    wanted = term_set(claim)
    part = len(wanted & term_set(evidence)) / max(1, len(wanted))
    return ("supported" if wanted and part >= 0.6 else "unsupported"), f"{part:.2f} of the terms"
