"""Language of texts by Bayesian fusion of the text, what is declared, the address and the host."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.frames import cut, text_slices

LANGUAGES = ("en", "de", "fr", "es")
#: Characters taken at a time: each trigram holds some 50 bytes while it is counted.
SLICE = 256 << 10
#: Byte trigrams are counted in so many buckets.
BUCKETS = 1 << 15
#: Neighbouring trigrams overlap, so a text weighs less than its trigrams one by one; and no text weighs more than so many of them.
TEXT_WEIGHT, MOST_TRIGRAMS = 0.3, 400
#: Pseudo-counts: of a trigram bucket, of a declared language or suffix, and of the parent's share in a host's prior.
BUCKET_COUNT, DECLARED_COUNT, PARENT_COUNT = 0.5, 1.0, 20.0


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts and the text each belongs to. Lower case; anything but letters is a border."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    letter = _LETTER[data]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    keep = letter.astype(bool)
    keep[1:] |= letter[:-1].astype(bool)  # one border after each word
    data, owner = np.where(letter, data, 32)[keep], owner[keep]
    if len(data) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    same = owner[:-2] == owner[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    return bucket[same], owner[:-2][same]


_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = 1


def declared_code(value: Column) -> Column:
    """The language of a declaration such as `en-GB`, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(value), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """What the page's html element declares."""
    return declared_code(F.regexp_extract(html, "(?is)<html[^>]*\\slang\\s*=\\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1))


def markup_text(html: Column) -> Column:
    """The page's text: scripts, styles, comments and tags out."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(text, "&[A-Za-z0-9#]+;", " ")


def train(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log likelihood of each bucket in each language (buckets x languages), from all rows whose
    declared language is one of them. Each task sends one row of counts a language."""
    def count(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), SLICE):
                bucket, owner = _folded(texts)
                language = np.array([languages.index(c) for c in codes[a:b]])[owner]
                counts += np.bincount(language * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        for i, row in enumerate(counts):
            some = np.nonzero(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(row[some])], ["language", "bucket", "n"])

    known = rows.select("declared", "text").where(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    got = known.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), BUCKET_COUNT)
    counts[got["bucket"].to_numpy(), got["language"].to_numpy()] += got["n"].to_numpy()
    return np.log(counts / counts.sum(0)).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray, to: str = "_text") -> DataFrame:
    """Adds an array: per language the weighted log likelihood of the text, 0 for all where there is no trigram."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed size

    @F.arrow_udf("array<float>")
    def score(texts: pa.Array) -> pa.Array:
        table = shared.value
        n = table.shape[1]
        found = []
        for a, b, values in text_slices(texts, SLICE):
            bucket, owner = _folded(values)
            hits = np.bincount(owner, minlength=b - a)
            sums = np.stack([np.bincount(owner, table[bucket, i], minlength=b - a) for i in range(n)], 1)
            weight = TEXT_WEIGHT * np.minimum(hits, MOST_TRIGRAMS) / np.maximum(hits, 1)
            sums = sums * weight[:, None]
            found.append((sums - sums.max(1, keepdims=True)).astype(np.float32))
        flat = np.concatenate(found) if found else np.empty((0, n), np.float32)
        return pa.array(list(flat), pa.list_(pa.float32()))

    return rows.withColumn(to, score(F.coalesce(F.col("text"), F.lit(""))))


def _best(scores: Column, languages: tuple[str, ...]) -> Column:
    return F.get(F.array([F.lit(c) for c in languages]), F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def _looked_up(value: str, table: dict[str, list[float]], languages) -> Column:
    nothing = F.array(*[F.lit(0.0)] * len(languages))
    found = nothing
    for v, logs in table.items():
        found = F.when(F.col(value) == v, F.array(*[F.lit(x) for x in logs])).otherwise(found)
    return found


def identify(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, accept: float = 0.65) -> DataFrame:
    """Adds language, confidence, text_language and accepted to rows with the columns text, declared, suffix and host; all else passes through.

    Four pieces of evidence multiply: the text (byte trigrams, trained on all rows by their declared language), the declared
    language and the address suffix (how often each goes with a language, by the text alone), and the host's prior. The prior is smoothed
    along host, suffix and all rows: each level's shares are drawn towards the level above by 20 rows. Host counts are a grouped aggregate
    with partial sums, so a host with a third of all rows sends one row a task; the prior per host is written to a table and joined,
    and Spark broadcasts it only if that table's size is under its own threshold.

    A row is accepted if its best language has a share of `accept` or more after fusion and it has any letter. A null text is
    empty; a text without letters is never accepted (its other evidence still names a language). Null declared, suffix or host say nothing
    (a null host takes the suffix's prior). A declared language outside `languages` says nothing and trains nothing. Ties go to the first language
    of the list. Repeated rows are judged alike; an empty table gives an empty result."""
    if any(c in rows.columns for c in ("language", "confidence", "text_language", "accepted")):
        raise ValueError("rename the columns language, confidence, text_language and accepted first")
    model = train(rows, languages)
    n = len(languages)
    scored = text_evidence(rows, model)
    scored = scored.withColumn("_letters", F.coalesce(F.col("text"), F.lit("")).rlike("\\p{L}"))
    # The filter is on the letters, not on what the Arrow function returns: that would run it twice.
    seen = scored.where("_letters").select("declared", "suffix", "host", _best(F.col("_text"), languages).alias("_first"))
    seen = cut(seen.groupBy("declared", "suffix", "host", "_first").agg(F.count("*").alias("_n")), "language-seen")
    weighted = seen.select("declared", "suffix", "host", *[F.when(F.col("_first") == c, F.col("_n")).otherwise(0).alias(f"l{i}") for i, c in enumerate(languages)], "_n")

    def table(value: str) -> dict[str, list[float]]:
        per = weighted.where(F.col(value).isNotNull()).groupBy(value).agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(n)], F.sum("_n").alias("n"))
        total = per.agg(F.sum("n")).first()[0] or 0
        kept = per.where(F.col(value).isin(*languages) | (F.col("n") >= total / 100)).collect()  # 100 and the languages at most
        sums = [sum(r[f"l{i}"] for r in kept) + DECLARED_COUNT * (len(kept) + 1) for i in range(n)]
        return {r[value]: [float(np.log((r[f"l{i}"] + DECLARED_COUNT) / sums[i])) for i in range(n)] for r in kept}

    declared, suffix = table("declared"), table("suffix")
    top = weighted.agg(*[F.sum(f"l{i}") for i in range(n)]).first()
    everywhere = [((x or 0) + 1.0) / (sum(y or 0 for y in top) + n) for x in top]
    groups = lambda *by: weighted.groupBy(*by).agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(n)])
    total = reduce(lambda a, b: a + b, [F.col(f"l{i}") for i in range(n)])
    by_suffix = groups("suffix").select(F.col("suffix").alias("_suffix"), F.array(*[(F.col(f"l{i}") + PARENT_COUNT * everywhere[i]) / (total + PARENT_COUNT) for i in range(n)]).alias("_parent"))
    parent = F.coalesce(F.col("_parent"), F.array(*[F.lit(x) for x in everywhere]))
    by_host = groups("host", "suffix").join(by_suffix, F.col("suffix").eqNullSafe(F.col("_suffix")), "left").select(
        F.col("host").alias("_host"), F.col("suffix").alias("_suffix"),
        F.when(F.col("host").isNull(), parent).otherwise(F.array(*[(F.col(f"l{i}") + PARENT_COUNT * parent[i]) / (total + PARENT_COUNT) for i in range(n)])).alias("_prior"))
    by_host = cut(by_host, "language-hosts")
    joined = scored.join(by_host, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
    prior = F.coalesce(F.col("_prior"), F.array(*[F.lit(x) for x in everywhere]))
    of_declared, of_suffix = _looked_up("declared", declared, languages), _looked_up("suffix", suffix, languages)
    joined = joined.withColumn("_sum", F.array(*[F.col("_text")[i] + F.log(prior[i]) + of_declared[i] + of_suffix[i] for i in range(n)]))
    share = 1 / F.aggregate(F.transform("_sum", lambda x: F.exp(x - F.array_max("_sum"))), F.lit(0.0), lambda a, b: a + b)
    return joined.select(
        *rows.columns, _best(F.col("_sum"), languages).alias("language"), F.round(share, 6).alias("confidence"),
        F.when(F.col("_letters"), _best(F.col("_text"), languages)).alias("text_language"), (F.col("_letters") & (share >= accept)).alias("accepted"))


def identify_documents(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, declared, language, confidence, text_language and accepted. The lang column is what is declared, the source is the
    host; documents have no address."""
    rows = docs.select("doc_id", "text", declared_code(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"))
    return identify(rows, languages).drop("text", "suffix", "host")


def identify_pages(pages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """page_id, host, declared, language, confidence, text_language and accepted: the html's declaration, the
    last label of the host as suffix, and the host."""
    from fleetlens.llm.url_filter import host_of

    host = F.nullif(host_of(F.col("url")), F.lit(""))
    rows = pages.select("page_id", markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), F.nullif(F.regexp_extract(host, "\\.([a-z]+)(?::[0-9]*)?$", 1), F.lit("")).alias("suffix"), host.alias("host"))
    return identify(rows, languages).drop("text", "suffix")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The documents whose language was accepted, with their own columns only, whatever those are called."""
    own = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col("text"), declared_code(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"))
    return identify(rows, languages).where("accepted").select("_doc.*")
