"""Token counts of whole texts by a public tokenizer, as lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.frames import handed_out, slices, text_slices

#: Counts of words kept by a worker, and the bytes of the words.
KEPT_WORDS, KEPT_BYTES = 300_000, 16 << 20

_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def _drops_space(spec: dict) -> bool:
    """Whether no token crosses white space, so that words can be counted one by one:
    the pre-tokenizer removes everything its pattern doesn't match, the pattern matches
    no white space, and no added token holds or swallows any."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s" in pattern and " ?" not in pattern and r"\s+" not in pattern
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    )


def _json_counter(content: bytes) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not _drops_space(json.loads(content)):
        return lengths
    known: dict[bytes, int] = {}
    kept = 0

    def by_word(texts: list[str]) -> list[int]:
        nonlocal kept
        # ASCII white space only: each of it is white space to every library, and none takes part in a normal form.
        rows = [t.encode().split() for t in texts]
        words = set().union(*rows)
        new = [w for w in words if w not in known]
        size = sum(map(len, new))
        if len(known) + len(new) > KEPT_WORDS or kept + size > KEPT_BYTES:
            known.clear()
            new, kept = list(words), 0
            size = sum(map(len, new))
        kept += size
        for a, b in slices([len(w) + 16 for w in new], 1 << 20):
            known.update(zip(new[a:b], lengths([w.decode() for w in new[a:b]])))
        return [sum(map(known.__getitem__, row)) for row in rows]

    return by_word


def _model_counter(content: bytes) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def counter(key: str, content: Broadcast, kind: str) -> Callable[[list[str]], list[int]]:
    """The worker's counter, built once per process."""
    if key not in _counters:
        _counters[key] = {".json": _json_counter, ".model": _model_counter}[kind](content.value)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """doc key, n_bytes (UTF-8), n_tokens and over_limit of every whole text, as the library
    of the vocabulary file (.json: tokenizers, .model: sentencepiece) counts them without special tokens.

    Texts never leave their task: an Arrow function gets them, cuts each batch into slices of equal
    bytes, and returns lengths. Where the tokenizer drops white space, texts are split there, each
    distinct word of a slice is encoded once, and counts of words are kept up to a fixed bound.

    A null or empty text has no bytes and no tokens. A text without white space is encoded as one
    piece. A null key stays null; repeated rows give repeated results; other columns are not read.
    An empty table gives an empty result."""
    name, content = handed_out(docs.sparkSession, vocabulary)
    kind = os.path.splitext(vocabulary)[1]

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        count = counter(name, content, kind)
        found: list[int] = []
        for _, _, values in text_slices(texts):
            found += count(values)
        return pa.array(found, pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), n_tokens(whole).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
