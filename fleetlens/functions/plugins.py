"""Model plug-ins as Arrow functions: encoders (UD3) and pair scorers (UD4).

The models themselves are the caller's. A plug-in is made by a factory that runs
once per Python worker, so a model is loaded once and not per batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.text import slices

WORD = re.compile(r"\w+")
BATCH = 32


def encoder(factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH):
    """UD3: Column function text -> vector; the model sees `batch` texts at a time."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            for part in slices(texts.fillna("")):
                values = texts[part].fillna("").tolist()
                vectors: list = []
                for i in range(0, len(values), batch):
                    vectors.extend(np.asarray(model(values[i:i + batch]), dtype="float32"))
                yield pd.Series(vectors, dtype="object")

    return encode


def hashing_model(size: int = 64):
    """The default model: words hashed into `size` slots (the first eight hex digits of their MD5), vectors of length one."""
    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for word in WORD.findall(text.lower()):
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return model


def scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8):
    """UD4: Column function (query, text) -> score. Pairs go to the model
    shortest first, so that a batch is not padded to one long text."""
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, texts in batches:
            pairs = list(zip(queries.fillna(""), texts.fillna("")))
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
            scores = np.zeros(len(pairs))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                scores[part] = model([pairs[j] for j in part])
            yield pd.Series(scores)

    return score


def shared_words_model():
    """A plain scorer: share of the query's words found in the text."""
    def model(pairs: list[tuple[str, str]]) -> list[float]:
        scores = []
        for query, text in pairs:
            wanted = set(WORD.findall(query.lower()))
            scores.append(len(wanted & set(WORD.findall(text.lower()))) / len(wanted) if wanted else 0.0)
        return scores

    return model
