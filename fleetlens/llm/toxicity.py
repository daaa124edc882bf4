"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.frames import cut, text_slices

#: The classifier is fitted on so many labelled rows of each class at most, taken in order of a hash of their ids.
EXAMPLES_PER_CLASS = 6_000
#: Terms that tell the classes apart: at most so many, each with a log-likelihood ratio (G2) of at least so much.
MOST_TERMS, LEAST_G2 = 2_048, 20.0
NEIGHBOURS, BLOCK = 32, 64
#: Added to a distance before it divides a vote; and the vote of the class shares, as if one example stood at distance 1.
NEAREST, PRIOR_VOTE = 0.05, 1 / 1.05
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(3)) == 1


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def print_of(found: list[str]) -> int:
    """The least hash of a text's four-word runs: texts that share most of them mostly share it."""
    runs = zip(found, found[1:], found[2:], found[3:]) if len(found) > 3 else [tuple(found)]
    return min(xxhash.xxh3_64_intdigest(" ".join(r)) for r in runs) >> 1


@dataclass
class Index:
    """Examples with equal vectors are one row. Rows are ordered by their terms and cut into blocks; each block has its postings (a
    row of weights for each of its terms) and the most that any of its rows holds of each term."""

    terms: dict[str, int]
    idf: np.ndarray
    weight: np.ndarray  # of each row's examples, after class weights
    toxic: np.ndarray  # of those with label 1
    ids: list[list[int]]  # some of the examples' ids
    none: tuple[float, float]  # weight and toxic weight of the examples without any term
    blocks: list[tuple[np.ndarray, np.ndarray]]
    most: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and unit weights of a text's terms."""
        counts = Counter(w for w in found if w in self.terms)
        at = np.array(sorted(self.terms[w] for w in counts), np.int64)
        by_number = {self.terms[w]: n for w, n in counts.items()}
        weights = np.array([1 + np.log(by_number[i]) for i in at.tolist()]) * self.idf[at]
        return at, (weights / np.sqrt((weights**2).sum()) if len(at) else weights).astype(np.float32)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest cosines and their rows, for dense query rows; exact. A block is read only by
        the queries for which its bound reaches their k-th cosine so far."""
        n = len(queries)
        best, who = np.zeros((n, NEIGHBOURS), np.float32), np.full((n, NEIGHBOURS), len(self.weight))
        if not self.blocks or not n:
            return best, who
        bounds = queries @ self.most.T + 1e-5
        first = bounds.argmax(1)

        def read(rows: np.ndarray, b: int) -> None:
            terms, postings = self.blocks[b]
            cosines = queries[np.ix_(rows, terms)] @ postings
            found = np.concatenate([best[rows], cosines], 1)
            rows_of = np.concatenate([who[rows], np.broadcast_to(b * BLOCK + np.arange(cosines.shape[1]), cosines.shape)], 1)
            order = np.lexsort((rows_of, -found), axis=1)[:, :NEIGHBOURS]
            best[rows], who[rows] = np.take_along_axis(found, order, 1), np.take_along_axis(rows_of, order, 1)

        for b in np.unique(first).tolist():
            read(np.nonzero(first == b)[0], b)
        for b in range(len(self.blocks)):
            rows = np.nonzero((first != b) & (bounds[:, b] >= best[:, -1]) & (bounds[:, b] > 2e-5))[0]
            if len(rows):
                read(rows, b)
        who[best <= 0] = len(self.weight)
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray, without: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The share of toxic votes, each vote divided by the distance. `without`: rows, weights and toxic weights to leave out."""
        weight, toxic = np.append(self.weight, 0.0)[who], np.append(self.toxic, 0.0)[who]
        if without:
            own = who == without[0][:, None]
            weight, toxic = weight - own * without[1][:, None], toxic - own * without[2][:, None]
        pull = 1 / (1 - np.minimum(best, 1.0) + NEAREST)
        base = self.share()
        unit = PRIOR_VOTE * max(float(np.median(self.weight)), 1e-9) if len(self.weight) else 1.0
        return ((pull * toxic).sum(1) + unit * base) / ((pull * weight).sum(1) + unit)

    def share(self) -> float:
        total = self.weight.sum() + self.none[0]
        return float((self.toxic.sum() + self.none[1]) / total) if total else 0.5

    def of_none(self) -> float:
        """The vote of a text without any term: that of the examples without any."""
        return (self.none[1] + self.share()) / (self.none[0] + 1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))

    def dense(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.terms)), np.float32)
        for i, (at, weights) in enumerate(vectors):
            out[i, at] = weights
        return out

    def scores(self, texts: list[str]) -> list[tuple[float, float, list[int]]]:
        """Score, greatest cosine and ids of nearest examples of each text."""
        vectors = [self.vector(words(t)) for t in texts]
        some = [i for i, (at, _) in enumerate(vectors) if len(at)]
        plain = float(self.calibrated(np.array([self.of_none()]))[0])
        out: list[tuple[float, float, list[int]]] = [(plain, 0.0, [])] * len(texts)
        for a in range(0, len(some), 512):
            part = some[a:a + 512]
            best, who = self.nearest(self.dense([vectors[i] for i in part]))
            for i, s, b, w in zip(part, self.calibrated(self.votes(best, who)).tolist(), best[:, 0].tolist(), who[:, :3].tolist()):
                out[i] = (s, min(b, 1.0), [self.ids[r][0] for r in w if r < len(self.ids)])
        return out


def _calibrate(index: Index, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, votes: np.ndarray) -> None:
    """A logistic curve through the left-out votes, with smoothed targets (Platt 1999)."""
    v = np.clip(votes, 1e-4, 1 - 1e-4)
    x = np.log(v / (1 - v))
    high, low = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = weights * (p - target)
        h = weights * np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        ga, gb = (g * x).sum(), g.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    if a > 0 and np.isfinite([a, b]).all():
        index.slope, index.shift = float(a), float(b)


def build(examples: list[tuple[int, int, list[str]]], n_docs: int, terms: list[str], df: dict[str, int], class_weight: dict[int, float]) -> Index:
    """The index of (id, label, words) examples."""
    numbers = {t: i for i, t in enumerate(terms)}
    idf = np.array([np.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in terms])
    index = Index(numbers, idf, np.empty(0), np.empty(0), [], (0.0, 0.0), [], np.empty((0, len(terms)), np.float32))
    folded: dict[tuple, list[tuple[int, int]]] = {}
    for key, label, found in examples:
        at, weights = index.vector(found)
        folded.setdefault((tuple(at.tolist()), weights.tobytes()), []).append((key, label))
    empty = folded.pop(((), b""), [])
    index.none = (sum(class_weight[y] for _, y in empty), sum(class_weight[y] for _, y in empty if y))
    def leading(group):
        at, weights = np.array(group[0]), np.frombuffer(group[1], np.float32)
        return [at[i] for i in np.argsort(-weights, kind="stable")], group[1]
    groups = sorted(folded, key=leading)
    index.weight = np.array([sum(class_weight[y] for _, y in folded[g]) for g in groups])
    index.toxic = np.array([sum(class_weight[y] for _, y in folded[g] if y) for g in groups])
    index.ids = [sorted(k for k, _ in folded[g])[:3] for g in groups]
    dense = index.dense([(np.array(g[0]), np.frombuffer(g[1], np.float32)) for g in groups])
    for a in range(0, len(groups), BLOCK):
        part = dense[a:a + BLOCK]
        held = np.nonzero(part.any(0))[0]
        index.blocks.append((held, np.ascontiguousarray(part[:, held].T)))
    index.most = np.stack([dense[a:a + BLOCK].max(0) for a in range(0, len(groups), BLOCK)]) if groups else index.most
    # Votes of the examples, each without itself.
    rows, labels, weights, votes = [], [], [], []
    for a in range(0, len(groups), 512):
        best, who = index.nearest(dense[a:a + 512])
        at = np.arange(a, a + len(best))
        for y in (0, 1):
            n = np.array([sum(label == y for _, label in folded[groups[r]]) for r in at])
            left = index.votes(best, who, (at, np.full(len(at), class_weight.get(y, 0.0)), np.full(len(at), class_weight.get(y, 0.0) * y)))
            some = n > 0
            rows.append(at[some]), labels.append(np.full(some.sum(), y)), weights.append(n[some] * class_weight.get(y, 0.0)), votes.append(left[some])
    for y in (0, 1):
        if n := sum(label == y for _, label in empty):
            rows.append([-1]), labels.append([y]), weights.append([n * class_weight[y]]), votes.append([index.of_none()])
    if rows:
        _calibrate(index, *(np.concatenate(x) for x in (rows, labels, weights, votes)))
    return index


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index from the rows of `labels` that are not held out.

    The examples are a bounded sample (EXAMPLES_PER_CLASS); the class shares are those of all labelled rows, and document frequencies are counted over
    all documents. The vocabulary is the terms whose presence differs between the classes beyond chance (G2)."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [given.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES_PER_CLASS) for y in (0, 1)]
    chosen = F.broadcast(cut(chosen[0].unionByName(chosen[1]), "toxic-chosen"))  # EXAMPLES_PER_CLASS rows of two numbers for each class
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").dropDuplicates(["doc_id"])

    @F.arrow_udf("print long, terms array<string>")
    def distinct(column: pa.Array) -> pa.Array:
        found = [words(t) for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([print_of(w) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string()))], ["print", "terms"])

    texts = cut(texts, "toxic-texts")
    taken = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 2:
        return build([], 0, [], {}, {0: 1.0, 1: 1.0})
    # Copies and most near copies of a text have one print, and count once.
    prints = cut(texts.select("toxic", distinct("text").alias("_d")).select("toxic", "_d.*"), "toxic-prints")
    sums = {r["toxic"]: r["n"] for r in prints.groupBy("toxic").agg(F.count_distinct("print").alias("n")).collect()}
    n1, n0 = sums[1], sums[0]
    per = prints.select("toxic", "print", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.sum("toxic").alias("k1"), F.count("*").alias("k")).where("k >= 3")
    k1, k0 = F.col("k1").cast("double"), (F.col("k") - F.col("k1")).cast("double")

    def part(k, n, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log1p(-p)).otherwise(0.0)

    both = (k1 + k0) / (n1 + n0)
    g2 = 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, both) - part(k0, n0, both))
    terms = sorted(r["term"] for r in per.withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "term").limit(MOST_TERMS).collect())
    df, n_docs = document_frequencies(docs, terms)
    vocabulary = set(terms)

    @F.arrow_udf("array<string>")
    def kept(column: pa.Array) -> pa.Array:
        return pa.array([[w for w in words(t) if w in vocabulary] for t in column.to_pylist()], pa.list_(pa.string()))

    rows = texts.select("doc_id", "toxic", kept("text").alias("found")).orderBy("doc_id").collect()  # the bounded sample
    return build([(r["doc_id"], r["toxic"], r["found"]) for r in rows], n_docs, terms, df, {y: totals[y] / taken[y] for y in taken})


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each term is, and how many there are. A task sends a number a term."""
    vocabulary = frozenset(terms)

    def count(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                found[""] += 1
                found.update(vocabulary.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    got = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r["term"]: r["n"] for r in got}
    return sums, sums.pop("", 0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, similarity and evidence (ids of up to three nearest examples) of every whole text.

    The index is fitted on labelled rows that are not held out and handed to every worker; its size is bounded by EXAMPLES_PER_CLASS and
    MOST_TERMS. Texts are read where they are, none is shuffled but the bounded sample. A score is a calibrated share of votes: each of the
    32 nearest example vectors votes with its labels' weights divided by its distance.

    A null or empty text, or one without any term of the vocabulary, gets the vote of the examples without any. A null doc_id stays null and is
    not held out. A doc_id with several labels counts as toxic if one says so, and is trained on one of its texts. Without labels of both classes
    every score is the same. Repeated rows score alike; ties between cosines go by the example vectors' order. Empty documents give an empty result."""
    index = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("score double, similarity double, evidence array<long>")
    def scored(texts: pa.Array) -> pa.Array:
        found: list[tuple[float, float, list[int]]] = []
        for _, _, values in text_slices(texts):
            found += shared.value.scores(values)
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["score", "similarity", "evidence"])

    return (
        docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), scored(F.coalesce("text", F.lit(""))).alias("_s"))
        .select("doc_id", "held_out", F.col("_s.score").alias("score"), (F.col("_s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_s.similarity").alias("similarity"), F.col("_s.evidence").alias("evidence"))
    )
