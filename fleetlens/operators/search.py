"""Hybrid search of many queries at once.

queries: query_id, domain, query, embedding, terms (array of entity names)
chunks:  chunk_id, doc_id, domain, content, applies_to_models, embedding
vectors: chunk_id, domain, embedding, where chunks have no vectors of their own: a join that would bring them together shuffles all texts"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens import session
from fleetlens.functions import text
from fleetlens.operators import skew

HITS = "query_id long, chunk_id long, score double"
K1, B = 1.2, 0.75
MAX_QUERIES = 4096
CELL_ROWS = 50_000
BLOCK_BYTES = 16 << 20
GRID_ROWS = 32_768
SLICE_WORDS = 1_000_000
FOUND = "chunk_id long, domain string, len long, words array<long>, tfs array<long>"
MAX_WORDS, MAX_ASKED = 500_000, 1_000_000


def _unit(vectors) -> np.ndarray:
    m = np.stack(vectors).astype("float64")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _nearest(query_vectors, chunk_ids, chunk_vectors, k: int, best=None):
    """Scores and ids of the k best chunks so far for each query; equal scores go to the lower id. Where there are fewer than k, the
    scores left are -inf. `best` is what earlier chunks gave. At most BLOCK_BYTES of scores exist at a time.

    Scores are first taken in single precision; those that can reach a query's k-th are taken again in double precision, rounded and
    sorted. Where they are many (copies), the block is taken again whole."""
    n, by_id = len(query_vectors), np.argsort(chunk_ids, kind="stable")
    step = max(k, BLOCK_BYTES // (8 * max(n, 1)))
    first = min(step, max(k, 256)) if best is None else 0
    if best is None:
        part = by_id[:first]
        scores = np.round(query_vectors @ chunk_vectors[part].T, 6)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        pad = ((0, 0), (0, k - top.shape[1]))
        best = np.pad(np.take_along_axis(scores, top, axis=1), pad, constant_values=-np.inf), np.pad(chunk_ids[part][top], pad)
    rough, slack = query_vectors.astype("float32"), 6e-7 + 1.2e-7 * (query_vectors.shape[1] + 8)
    for i in range(first, len(by_id), step):
        part = by_id[i:i + step]
        ids, vectors = chunk_ids[part], chunk_vectors[part]
        last = np.where(np.isnan(best[0][:, -1]), -np.inf, best[0][:, -1])
        # An equal score counts only for an id below the k-th; ids come in order.
        least = last + np.where(best[1][:, -1] < ids[0], 4e-7, -6e-7)
        at = np.flatnonzero(rough @ vectors.astype("float32").T >= (last - slack).astype("float32")[:, None])
        if len(at) * 64 > n * len(ids):
            row, col = np.nonzero((scores := query_vectors @ vectors.T) >= least[:, None])
            score = scores[row, col]
        else:
            row, col = np.divmod(at, len(ids))
            score = np.einsum("ij,ij->i", query_vectors[row], vectors[col])
            row, col, score = (x[score >= least[row]] for x in (row, col, score))
        if not len(row):
            continue
        own = np.unique(row)
        rows = np.concatenate((np.repeat(own, k), row))
        every, found = np.concatenate((best[0][own].ravel(), np.round(score, 6))), np.concatenate((best[1][own].ravel(), ids[col]))
        order = np.lexsort((found, -every, rows))
        take = order[np.searchsorted(rows[order], own)[:, None] + np.arange(k)]
        best[0][own], best[1][own] = every[take], found[take]
    return best


def _hits(query_ids, best) -> pd.DataFrame:
    scores, ids = best
    there = scores.ravel() > -np.inf
    there |= np.isnan(scores.ravel())
    return pd.DataFrame({"query_id": np.repeat(query_ids, ids.shape[1])[there], "chunk_id": ids.ravel()[there], "score": scores.ravel()[there]})


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, max_queries: int = MAX_QUERIES,
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """J15/DP10: the k nearest chunks of each query within its domain, exact. A query or chunk without a vector takes no part.

    Each task scores its chunks as matrix products of bounded size and keeps k per query, so
    pairs are never rows. Up to `max_queries` queries (counted first) travel to
    the tasks and the chunks stay where they are. More queries are cut into
    blocks, chunks into cells of about `cell_rows` by a hash of their id (larger ones of many, see `skew.grid`), and
    each block meets each cell; a domain with most of the chunks has most cells."""
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "domain", "embedding")
    c = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", "domain", "embedding")
    head = q.limit(max_queries + 1).toPandas()
    if head.empty:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")
    if len(head) <= max_queries:
        sides = {d: (g["query_id"].to_numpy(), _unit(g["embedding"])) for d, g in head.groupby("domain")}

        def score(batches):
            best = {}
            for batch in batches:
                for domain, rows in batch.groupby("domain"):
                    if domain in sides:
                        best[domain] = _nearest(sides[domain][1], rows["chunk_id"].to_numpy(), _unit(rows["embedding"]), k, best.get(domain))
            for domain, found in best.items():
                yield _hits(sides[domain][0], found)

        hits = c.mapInPandas(score, HITS)
    else:
        blocks, cells = skew.grid(q.count(), max_queries, GRID_ROWS), skew.grid(c.count(), cell_rows, GRID_ROWS)
        left = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
            "_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<long>")))
        right = c.withColumn("_cell", F.pmod(F.xxhash64("chunk_id"), F.lit(cells))).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
            return _hits(a["query_id"].to_numpy(), _nearest(_unit(a["embedding"]), b["chunk_id"].to_numpy(), _unit(b["embedding"]), k))

        keys = ["domain", "_block", "_cell"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, HITS)
    return skew.top_per_key(hits, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def _slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """A batch of texts in parts of about SLICE_WORDS words: what is computed for a word is bounded, however long the texts are."""
    upto = np.cumsum(pc.list_value_length(batch.column("_words")).to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE_WORDS)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _found(asked: DataFrame, chunks: DataFrame, max_words: int) -> DataFrame:
    """chunk_id, domain, len, words, tfs: per chunk its words in all, and which of the asked words it has how often
    (words as numbers). Up to `max_words` different words travel to the texts, which stay where they are; a larger set
    is joined to the words of the texts."""
    tokens = session.spread(chunks.where(F.col("content").isNotNull()).select("chunk_id", "domain", "content")).select("chunk_id", "domain", F.array_append(text.tokens(F.col("content")), F.lit("")).alias("_words"))
    wanted = asked.select("word", "_word").distinct()
    head = wanted.limit(max_words + 1).toArrow()
    if head.num_rows <= max_words:
        names, numbers = head.column("word").combine_chunks(), head.column("_word").to_numpy()

        def count(batches):
            for batch in (part for whole in batches for part in _slices(whole)):
                lists = batch.column("_words")
                sizes = pc.list_value_length(lists).to_numpy()
                at = pc.index_in(lists.flatten(), value_set=names)
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)[hit]
                pair, tf = np.unique(row * np.int64(len(names) + 1) + pc.fill_null(at, 0).to_numpy()[hit], return_counts=True)
                row, word = np.divmod(pair, len(names) + 1)
                ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype("int32"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("chunk_id"), batch.column("domain"), pa.array(sizes.astype("int64") - 1),
                    pa.ListArray.from_arrays(ends, pa.array(numbers[word] if len(names) else word)), pa.ListArray.from_arrays(ends, pa.array(tf))],
                    ["chunk_id", "domain", "len", "words", "tfs"])

        found = tokens.mapInArrow(count, FOUND)
    else:
        # The empty word keeps a row of every chunk.
        rows = tokens.select("chunk_id", "domain", (F.size("_words") - 1).alias("len"), F.explode("_words").alias("word"))
        named = wanted.unionByName(wanted.sparkSession.createDataFrame([("", None)], "word string, _word long"))
        counts = rows.join(named, "word").groupBy("chunk_id", "domain", "len", "_word").agg(F.count(F.lit(1)).alias("_tf"))
        pair = F.sort_array(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_tf"))))
        found = counts.groupBy("chunk_id", "domain", "len").agg(pair.alias("_p")).select(
            "chunk_id", "domain", F.col("len").cast("long").alias("len"), F.col("_p._word").alias("words"), F.col("_p._tf").alias("tfs"))
    # Short chunks first: their words weigh most, so the first blocks set a high k-th score.
    return session.cut(found.sortWithinPartitions("domain", "len"), "found")


class _Side:
    """The queries of a domain: their words' weights, and the k best chunks of each so far."""

    def __init__(self, query_ids, words, idf, mean: float, k: int):
        order = np.argsort(query_ids, kind="stable")
        ids, starts = np.unique(query_ids[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.queries = [(q, words[order[a:b]], idf[order[a:b]]) for q, a, b in zip(ids.tolist(), starts, ends)]
        self.mean, self.k, self.best = mean, k, {}

    def meet(self, ids, lengths, words, tfs, sizes) -> None:
        """Chunks as posting blocks, one a word, each with the most it can add. A query whose words' bounds stay
        under its k-th score passes the blocks by."""
        if not len(words):
            return
        row = np.repeat(np.arange(len(ids)), sizes)
        part = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lengths[row] / self.mean))
        order = np.argsort(words, kind="stable")
        names, starts = np.unique(words[order], return_index=True)
        row, part, ends = row[order], part[order], np.append(starts[1:], len(order))
        most = np.maximum.reduceat(part, starts)
        for q, asked, idf in self.queries:
            at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            here = names[at] == asked
            at, weight = at[here], idf[here]
            best = self.best.get(q)
            full = best is not None and len(best[0]) == self.k
            if not len(at) or full and (weight * most[at]).sum() + 2e-6 < best[0][-1]:
                continue
            total = np.zeros(len(ids))
            for i, w in zip(at.tolist(), weight.tolist()):
                total[row[starts[i]:ends[i]]] += w * part[starts[i]:ends[i]]
            hit = np.flatnonzero(total > (best[0][-1] - 2e-6 if full else 0))
            scores, found = np.round(total[hit], 6), ids[hit]
            if best is not None:
                scores, found = np.concatenate((best[0], scores)), np.concatenate((best[1], found))
            top = np.lexsort((found, -scores))[:self.k]
            self.best[q] = scores[top], found[top]

    def hits(self) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": q, "chunk_id": ids, "score": scores}) for q, (scores, ids) in self.best.items()]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []}).astype({"query_id": "int64", "chunk_id": "int64"})


def _meet(side: _Side, rows: pd.DataFrame) -> None:
    sizes = rows["words"].map(len).to_numpy()
    side.meet(rows["chunk_id"].to_numpy(), rows["len"].to_numpy().astype("float64"), np.concatenate([np.asarray(w, dtype="int64") for w in rows["words"]]),
              np.concatenate([np.asarray(w, dtype="float64") for w in rows["tfs"]]), sizes)


def sparse_top_k(queries: DataFrame, chunks: DataFrame, k: int, max_words: int = MAX_WORDS, max_asked: int = MAX_ASKED,
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """DP11: the k best chunks of each query by BM25 within its domain, any of
    the query's words counting but the stop words, whether or not a chunk has a vector. Exact.

    The texts are read once and give a row per chunk: the asked words in it. Scores add up where these rows are, a block
    of chunks at a time with a posting list and a bound for each word, and a task keeps k per query: pairs of
    query and chunk are never rows, and a word that is in every chunk is cut into blocks like any other. Up to
    `max_asked` words of queries (counted first) travel to the rows; more are cut into blocks of
    queries, and each block meets each cell of chunks."""
    asked = queries.select("query_id", "domain", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("word")).where(
        ~F.col("word").isin(ref.ENGLISH_STOP_WORDS)).withColumn("_word", F.xxhash64("word"))
    asked = session.cut(asked, "asked")
    found = _found(asked, chunks, max_words)
    sizes = found.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"), F.avg("len").alias("_mean"))
    frequency = found.select("domain", F.explode("words").alias("_word")).groupBy("domain", "_word").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = asked.join(frequency, ["domain", "_word"]).join(F.broadcast(sizes), "domain").select("query_id", "domain", "_word", idf.alias("_idf"), "_mean")

    head = weights.limit(max_asked + 1).toPandas()
    if len(head) <= max_asked:
        by_domain = {d: (g["query_id"].to_numpy(), g["_word"].to_numpy(), g["_idf"].to_numpy(), g["_mean"].iat[0]) for d, g in head.groupby("domain")}

        def score(batches):
            sides = {d: _Side(*side, k) for d, side in by_domain.items()}
            for batch in batches:
                for domain, rows in batch.groupby("domain"):
                    if domain in sides:
                        _meet(sides[domain], rows)
            for side in sides.values():
                yield side.hits()

        hits = found.where(F.size("words") > 0).mapInPandas(score, HITS)
    else:
        weights = session.cut(weights, "weights")
        blocks = -(-weights.count() // max_asked)
        cells = -(-found.count() // cell_rows)
        left = weights.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
            "_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<long>")))
        right = found.where(F.size("words") > 0).withColumn("_cell", F.pmod(F.xxhash64("chunk_id"), F.lit(cells))).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            side = _Side(a["query_id"].to_numpy(), a["_word"].to_numpy(), a["_idf"].to_numpy(), a["_mean"].iat[0] if len(a) else 1.0, k)
            if len(a) and len(b):
                _meet(side, b)
            return side.hits()

        keys = ["domain", "_block", "_cell"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, HITS)
    return skew.top_per_key(hits, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = ref.RRF_K, dense_weight: float = ref.DENSE_WEIGHT,
         sparse_weight: float = ref.SPARSE_WEIGHT) -> DataFrame:
    """DP12/J8: weighted reciprocal rank fusion; a chunk found by one side only stays."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))

    def share(weight, rank):
        return F.coalesce(weight / (rrf_k + F.col(rank)), F.lit(0.0))

    return d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn(
        "hybrid_score", share(F.lit(dense_weight), "dense_rank") + share(F.lit(sparse_weight), "sparse_rank"))


def with_boost(fused: DataFrame, queries: DataFrame, chunks: DataFrame, boost: float = ref.ENTITY_BOOST,
               k: int = ref.CANDIDATE_K) -> DataFrame:
    """DP13: the first k candidates in boosted order; a chunk counts more when its
    models or its text name an entity of the query. Nothing is removed for not doing so.
    The hits are few rows per query: they are written, measured and sent to the
    chunks. The boost is decided there, so that no text goes on."""
    low = F.transform(F.col("terms"), lambda x: F.lower(x))
    models = F.transform(F.col("applies_to_models"), lambda x: F.lower(x))
    named = F.arrays_overlap(low, models) | F.exists(low, lambda x: F.contains(F.lower("content"), x))
    asked = session.cut(fused.join(queries.select("query_id", "terms"), "query_id"), "fused")
    rows = chunks.select("chunk_id", "doc_id", "content", "applies_to_models").join(skew.small(asked, 500_000), "chunk_id")
    rows = rows.withColumn("boost", F.when(F.coalesce(named, F.lit(False)), boost).otherwise(0.0)).drop("terms", "applies_to_models", "content")
    order = [F.desc(F.round(F.col("hybrid_score") * (1 + F.col("boost")), 9)), F.asc_nulls_last("dense_rank"),
             F.asc_nulls_last("sparse_rank"), F.col("chunk_id")]
    return skew.top_per_key(rows, ["query_id"], order, k, "position")


def _far_ahead(top, second, margin: float):
    return F.when(second.isNull(), True).when(top <= 0, False).otherwise(F.try_divide(top - second, top) >= margin)


def decisive(candidates: DataFrame, margin: float = ref.RERANK_SKIP_MARGIN) -> DataFrame:
    """Per query, whether the leader is so far ahead that only it is scored."""
    top, second = (F.max(F.when(F.col("position") == p, F.col("hybrid_score"))) for p in (1, 2))
    return candidates.where("position <= 2").groupBy("query_id").agg(_far_ahead(top, second, margin).alias("rerank_skipped"))


def rerank(candidates: DataFrame, score=text.word_overlap, shortlist: int = ref.RERANK_CANDIDATES,
           final_k: int = ref.FINAL_K, queries: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """DP14: the shortlist scored by `score(query, content)`, a Column function or
    a plug-in; the boost reorders but stays out of the stored score. The texts of the shortlist
    alone are fetched from `queries` and `chunks`, unless the candidates carry them."""
    short = candidates.where(F.col("position") <= shortlist)
    w = Window.partitionBy("query_id")               # the shortlist of one query
    lead = [F.max(F.when(F.col("position") == p, F.col("hybrid_score"))).over(w) for p in (1, 2)]
    short = short.withColumn("rerank_skipped", _far_ahead(*lead, ref.RERANK_SKIP_MARGIN))
    short = short.where(~F.col("rerank_skipped") | (F.col("position") == 1))
    if chunks is not None:
        short = session.cut(short, "shortlist").join(skew.small(queries.select("query_id", "query")), "query_id")
        short = chunks.select("chunk_id", "content").join(skew.small(short, 500_000), "chunk_id")
    scored = short.withColumn("rerank_score", F.round(score(F.col("query"), F.col("content")), 4)).drop("query", "content")
    order = [F.desc(F.round(F.col("rerank_score") * (1 + F.col("boost")), 9)), F.col("position")]
    return skew.top_per_key(scored, ["query_id"], order, final_k, "final_rank")


def with_status(queries: DataFrame, ranked: DataFrame, threshold: float = ref.CONFIDENCE_THRESHOLD) -> DataFrame:
    """DP15: every query with its status, best score and number of kept chunks."""
    per = ranked.groupBy("query_id").agg(
        F.max("rerank_score").alias("best_score"), F.count(F.when(F.col("rerank_score") >= threshold, 1)).alias("kept"))
    status = F.when(F.col("best_score").isNull(), "empty").when(F.col("kept") > 0, "ok").otherwise("below_threshold")
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id", status.alias("status"), "best_score", F.coalesce("kept", F.lit(0)).alias("kept"))


def candidates(queries: DataFrame, chunks: DataFrame, k: int = ref.CANDIDATE_K, vectors: DataFrame | None = None) -> DataFrame:
    fused = fuse(dense_top_k(queries, chunks if vectors is None else vectors, k), sparse_top_k(queries, chunks, k))
    return with_boost(fused, queries, chunks, k=k)


def search(queries: DataFrame, chunks: DataFrame, threshold: float = ref.CONFIDENCE_THRESHOLD, score=text.word_overlap,
           vectors: DataFrame | None = None) -> DataFrame:
    """DP16: every query with its status and, one row each, the chunks it keeps."""
    ranked = session.cut(rerank(candidates(queries, chunks, vectors=vectors), score, queries=queries, chunks=chunks), "ranked")
    kept = ranked.where(F.col("rerank_score") >= threshold).select(
        "query_id", "final_rank", "chunk_id", "doc_id", "rerank_score", (F.col("boost") > 0).alias("boosted"), "rerank_skipped")
    return with_status(queries, ranked, threshold).join(kept, "query_id", "left")


def retrieval_report(rows: DataFrame, threshold: float) -> DataFrame:
    """AG23: per language of the answerable questions: recall, hits, accepted.
    rows: lang, answerable, in_candidates, hit, doc_score, best_score"""
    accepted = F.col("hit") & (F.col("doc_score") >= threshold)
    return rows.where("answerable").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("in_candidates").cast("double")).alias("candidate_recall"),
        F.avg(F.col("hit").cast("double")).alias("hit"), F.avg(F.coalesce(accepted, F.lit(False)).cast("double")).alias("accepted"))


def false_accepts(rows: DataFrame, threshold: float) -> DataFrame:
    """AG24: share of unanswerable questions that got an answer."""
    return rows.where("NOT answerable").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("best_score") >= threshold).cast("double")).alias("false_accept_rate"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """AG25: separation at 0.05 .. 0.95, all thresholds in one pass; the highest
    of the best is marked."""
    grid = [round(0.05 * i, 2) for i in range(1, 20)]

    def right(limit):
        accepted = F.col("answerable") & F.col("hit") & (F.col("doc_score") >= limit)
        return F.coalesce(accepted | (~F.col("answerable") & (F.col("best_score") < limit)), F.lit(False))

    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(right(g), 1)).alias(f"_s{i}") for i, g in enumerate(grid)])
    long = wide.select("n", F.inline(F.array(*[
        F.struct(F.lit(g).alias("threshold"), F.col(f"_s{i}").alias("right")) for i, g in enumerate(grid)])))
    w = Window.orderBy(F.desc("right"), F.desc("threshold"))
    return long.select("threshold", F.round(F.col("right") / F.col("n"), 3).alias("separation"),
                       (F.row_number().over(w) == 1).alias("suggested"))
