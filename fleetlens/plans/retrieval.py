"""Search over the stored vectors and texts, and matching of written ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.functions import fuzzy, plugins, text
from fleetlens.operators import matching, search, skew
from fleetlens.plans.registry import query
from fleetlens.plans.library import CONTENT_WORDS

SIDE = "CASE WHEN {0} % 2 = 0 THEN 'diagnostic' ELSE 'business' END"
CHUNKS = f"""chunks AS (SELECT d.doc_id AS chunk_id, {SIDE.format('d.doc_id')} AS domain, text AS content, source AS model, embedding
             FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
QUERIES = f"""queries AS (SELECT b.item_id AS query_id, {SIDE.format('b.item_id')} AS domain, text AS query, embedding,
              'src' || (b.item_id % 20) AS term FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""
DENSE = """dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
           FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
                 FROM queries q JOIN chunks c ON c.domain = q.domain WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL) QUALIFY rank <= 50)"""
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ref.ENGLISH_STOP_WORDS)
SPARSE = rf"""tok AS (SELECT chunk_id, domain, list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM chunks),
    post AS (SELECT chunk_id, domain, len(ws) AS dl, unnest(ws) AS word FROM tok),
    tf AS (SELECT domain, word, chunk_id, count(*) AS tf, max(dl) AS dl FROM post GROUP BY 1, 2, 3),
    df AS (SELECT domain, word, count(*) AS df FROM tf GROUP BY 1, 2),
    sz AS (SELECT domain, count(*) AS n, avg(len(ws)) AS mean FROM tok GROUP BY 1),
    qt AS (SELECT DISTINCT query_id, domain, word FROM (SELECT query_id, domain, unnest(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+')) AS word FROM queries) WHERE word <> '' AND word NOT IN ({STOP})),
    sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
      FROM qt JOIN tf USING (domain, word) JOIN df USING (domain, word) JOIN sz USING (domain) GROUP BY 1, 2) QUALIFY rank <= 50)"""
FUSED = """fused AS (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank,
           coalesce(0.6 / (60 + d.rank), 0) + coalesce(0.4 / (60 + s.rank), 0) AS hybrid_score
           FROM dense d FULL JOIN sparse s USING (query_id, chunk_id))"""
BOOSTED = """boosted AS (SELECT f.*, q.query, c.content, CASE WHEN lower(c.model) = lower(q.term) OR contains(lower(c.content), lower(q.term)) THEN 0.15 ELSE 0 END AS boost
             FROM fused f JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)),
    cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score * (1 + boost), 9) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS position
             FROM boosted QUALIFY position <= 50)"""
RERANKED = f"""skip AS (SELECT query_id, CASE WHEN b IS NULL THEN true WHEN a <= 0 THEN false ELSE (a - b) / a >= 0.25 END AS rerank_skipped FROM (
      SELECT query_id, max(hybrid_score) FILTER (position = 1) AS a, max(hybrid_score) FILTER (position = 2) AS b FROM cand GROUP BY 1)),
    short AS (SELECT *, {CONTENT_WORDS.format('query')} AS qw, {CONTENT_WORDS.format('content')} AS cw FROM cand JOIN skip USING (query_id)
              WHERE position <= 10 AND (NOT rerank_skipped OR position = 1)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score * (1 + boost), 9) DESC, position) AS final_rank FROM (
      SELECT *, round(CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, cw)) / len(qw) END, 4) AS rerank_score FROM short) QUALIFY final_rank <= 5)"""
STATUS = """status AS (SELECT query_id, CASE WHEN best_score IS NULL THEN 'empty' WHEN kept > 0 THEN 'ok' ELSE 'below_threshold' END AS status, best_score, coalesce(kept, 0) AS kept
            FROM queries LEFT JOIN (SELECT query_id, max(rerank_score) AS best_score, count(*) FILTER (rerank_score >= 0.3) AS kept FROM ranked GROUP BY 1) USING (query_id))"""


def upto(*parts):
    return "WITH " + ", ".join(parts) + " "


def side(column):
    return F.when(F.col(column) % 2 == 0, "diagnostic").otherwise("business")


def chunk_table(t):
    """Every document; one without a vector is found by its words."""
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", side("doc_id").alias("domain"), F.col("text").alias("content"),
                              F.array("source").alias("applies_to_models"))


def chunk_vectors(t):
    """The vectors of the documents that have one."""
    ids = t.documents.select(F.col("doc_id").alias("chunk_id"))
    return ids.join(t.embeddings, F.col("chunk_id") == F.col("vec_id")).select("chunk_id", side("chunk_id").alias("domain"), "embedding")


def query_table(t):
    term = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    return t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("query_id"), side("item_id").alias("domain"), F.col("text").alias("query"), "embedding",
        F.array(term).alias("terms"))


def vector_queries(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.lit("all").alias("domain"), "embedding")


def vector_chunks(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("domain"), "embedding")


@query("j15_nearest_vectors", """
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b QUALIFY rank <= 5""")
def nearest_vectors(t):
    """Every stored vector against all vectors."""
    return search.dense_top_k(vector_queries(t), vector_chunks(t), 5)


@query("j15_nearest_vectors_in_cells", """
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b QUALIFY rank <= 3""")
def nearest_vectors_in_cells(t):
    """The same with more queries than travel at once: blocks of queries meet cells of chunks."""
    return search.dense_top_k(vector_queries(t), vector_chunks(t), 3, max_queries=200, cell_rows=300)


@query("sf21_cosine", """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(t):
    from fleetlens.functions import vector
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("dp10_dense_candidates", upto(CHUNKS, QUERIES, DENSE) + "SELECT * FROM dense")
def dense_candidates(t):
    return search.dense_top_k(query_table(t), chunk_vectors(t), 50)


@query("dp11_sparse_candidates", upto(CHUNKS, QUERIES, SPARSE) + "SELECT * FROM sparse")
def sparse_candidates(t):
    return search.sparse_top_k(query_table(t), chunk_table(t), 50)


@query("dp12_fused_ranks", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED) + "SELECT query_id, chunk_id, dense_rank, sparse_rank, round(hybrid_score, 9) AS hybrid_score FROM fused")
def fused_ranks(t):
    """J8/W8/DP12"""
    q, c = query_table(t), chunk_table(t)
    return search.fuse(search.dense_top_k(q, chunk_vectors(t), 50), search.sparse_top_k(q, c, 50)).withColumn("hybrid_score", F.round("hybrid_score", 9))


@query("dp13_boosted_candidates", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED) + "SELECT query_id, chunk_id, position, boost::DOUBLE AS boost FROM cand")
def boosted_candidates(t):
    return search.candidates(query_table(t), chunk_table(t), vectors=chunk_vectors(t)).select("query_id", "chunk_id", "position", "boost")


@query("w09_decisive_leader", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED, RERANKED) + "SELECT query_id, rerank_skipped FROM skip")
def decisive_leader(t):
    return search.decisive(search.candidates(query_table(t), chunk_table(t), vectors=chunk_vectors(t)))


@query("dp14_reranked", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED, RERANKED) + "SELECT query_id, chunk_id, final_rank, rerank_score FROM ranked")
def reranked(t):
    q, c = query_table(t), chunk_table(t)
    return search.rerank(search.candidates(q, c, vectors=chunk_vectors(t)), queries=q, chunks=c).select("query_id", "chunk_id", "final_rank", "rerank_score")


WORD_SETS = """list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')), lambda x: x <> '')"""


@query("ud04_pair_scorer", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED, RERANKED.replace(CONTENT_WORDS.format("query"), WORD_SETS.format("query")).replace(
    CONTENT_WORDS.format("content"), WORD_SETS.format("content"))) + "SELECT query_id, chunk_id, final_rank, rerank_score FROM ranked")
def pair_scorer(t):
    """The shortlist scored by a plug-in model in small batches."""
    score = plugins.scorer(plugins.shared_words_model)
    q, c = query_table(t), chunk_table(t)
    return search.rerank(search.candidates(q, c, vectors=chunk_vectors(t)), score, queries=q, chunks=c).select("query_id", "chunk_id", "final_rank", "rerank_score")


@query("ud03_encoder", r"""
    WITH w AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '[\p{L}\p{N}_]+')) AS word FROM pages),
    s AS (SELECT page_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INT AS slot, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT page_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY page_id)))::FLOAT::DOUBLE, 4) AS value FROM s""")
def encoder(t):
    """Every page text encoded by the default model; the slots that are not empty."""
    encode = plugins.encoder(plugins.hashing_model)
    slots = t.pages.select("page_id", F.posexplode(encode(F.col("html"))).alias("slot", "value")).where("value > 0")
    return slots.select("page_id", "slot", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("dp15_search_status", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED, RERANKED, STATUS) + "SELECT * FROM status")
def search_status(t):
    q, c = query_table(t), chunk_table(t)
    return search.with_status(q, search.rerank(search.candidates(q, c, vectors=chunk_vectors(t)), queries=q, chunks=c))


@query("dp16_batch_search", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED, BOOSTED, RERANKED, STATUS) + """
    SELECT s.*, final_rank, chunk_id, chunk_id AS doc_id, rerank_score, boost > 0 AS boosted, rerank_skipped
    FROM status s LEFT JOIN (SELECT * FROM ranked WHERE rerank_score >= 0.3) r USING (query_id)""")
def batch_search(t):
    return search.search(query_table(t), chunk_table(t), vectors=chunk_vectors(t))


EVAL = """near AS (SELECT a.vec_id AS q, a.label AS label, b.label AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 10),
    rows_ AS (SELECT q, 'l' || (label % 3) AS lang, label <> 0 AS answerable, bool_or(other = label) AS in_candidates, bool_or(other = label AND rank <= 5) AS hit,
             max(s) FILTER (other = label AND rank <= 5) AS doc_score, max(s) AS best_score FROM near GROUP BY q, label)"""


def judged_queries(t):
    """Vectors as questions: the label is the wanted document, label 0 has none."""
    label = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    other = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("other"))
    hits = search.dense_top_k(vector_queries(t), vector_chunks(t), 11).where("query_id <> chunk_id")
    top = skew.top_per_key(hits.drop("rank"), ["query_id"], [F.desc("score"), F.col("chunk_id")], 10)
    same = F.col("other") == F.col("label")
    return top.join(label, "query_id").join(other, "chunk_id").groupBy("query_id", "label").agg(
        F.bool_or(same).alias("in_candidates"), F.bool_or(same & (F.col("rank") <= 5)).alias("hit"),
        F.max(F.when(same & (F.col("rank") <= 5), F.col("score"))).alias("doc_score"), F.max("score").alias("best_score")).select(
        "*", F.concat(F.lit("l"), (F.col("label") % 3).cast("string")).alias("lang"), (F.col("label") != 0).alias("answerable"))


@query("ag23_retrieval_by_language", upto(EVAL) + """
    SELECT lang, count(*) AS n, round(avg(in_candidates::INT), 6) AS candidate_recall, round(avg(hit::INT), 6) AS hit,
           round(avg(coalesce(hit AND doc_score >= 0.3, false)::INT), 6) AS accepted FROM rows_ WHERE answerable GROUP BY 1""")
def retrieval_by_language(t):
    out = search.retrieval_report(judged_queries(t), 0.3)
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("candidate_recall", "hit", "accepted")])


@query("ag24_false_accepts", upto(EVAL) + "SELECT count(*) AS n, round(avg((best_score >= 0.3)::INT), 6) AS false_accept_rate FROM rows_ WHERE NOT answerable")
def false_accepts(t):
    return search.false_accepts(judged_queries(t), 0.3).withColumn("false_accept_rate", F.round("false_accept_rate", 6))


@query("ag24_negative_scores", upto(EVAL) + "SELECT q AS query_id, best_score FROM rows_ WHERE NOT answerable")
def negative_scores(t):
    """Best scores of unanswerable questions, in order."""
    return judged_queries(t).where("NOT answerable").select("query_id", "best_score").orderBy("best_score", "query_id")


@query("ag25_threshold_sweep", upto(EVAL) + """, g AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 20) r(i)),
    s AS (SELECT threshold, count(*) FILTER (CASE WHEN answerable THEN coalesce(hit AND doc_score >= threshold, false) ELSE best_score < threshold END) AS ok, count(*) AS n FROM g, rows_ GROUP BY 1)
    SELECT threshold, round(ok / n, 3) AS separation, row_number() OVER (ORDER BY ok DESC, threshold DESC) = 1 AS suggested FROM s""")
def threshold_sweep(t):
    return search.threshold_sweep(judged_queries(t))


# written ids

FLEET = "fleet AS (SELECT 'V-' || lpad(c_custkey::VARCHAR, 6, '0') AS known, c_custkey AS k, c_name, c_nationkey FROM customer)"
MENTIONS = FLEET + """, mentions AS (
    SELECT 'v ' || k AS raw FROM fleet UNION ALL SELECT k::VARCHAR FROM fleet UNION ALL SELECT known FROM fleet
    UNION ALL SELECT 'V-' || c_nationkey FROM fleet UNION ALL SELECT '  ' FROM fleet)"""


def fleet(t):
    return t.customer.select(F.format_string("V-%06d", F.col("c_custkey")).alias("known"), "c_custkey", "c_nationkey")


def mentions(t):
    k = F.col("c_custkey").cast("string")
    spelled = F.array(F.concat(F.lit("v "), k), k, F.col("known"), F.concat(F.lit("V-"), F.col("c_nationkey").cast("string")), F.lit("  "))
    return fleet(t).select(F.explode(spelled).alias("raw"))


@query("dp17_resolved_ids", "WITH " + MENTIONS + r"""
    SELECT raw, count(*) AS mentions, CASE WHEN trim(raw) = '' THEN 'not_found' ELSE 'exact' END AS status,
           CASE WHEN trim(raw) <> '' THEN 'V-' || lpad(regexp_extract(raw, '(\d+)', 1)::INT::VARCHAR, 6, '0') END AS value,
           CASE WHEN trim(raw) = '' THEN 'No vehicle id was given.' END AS note FROM mentions GROUP BY raw""")
def resolved_ids(t):
    """Five spellings of every id; a spelling used by many is resolved once."""
    return matching.resolve(mentions(t), fleet(t).select("known")).select("raw", "mentions", "status", "value", "note")


def misspelled(t):
    """Every id with its last two characters swapped and one more digit."""
    k = F.col("known")
    return fleet(t).select(F.concat(F.substring(k, 1, 6), F.substring(k, 8, 1), F.substring(k, 7, 1), F.lit("9")).alias("raw"))


# Two ids whose longest common subsequence is L share a subsequence of that length; ids this short reach the scores
# only with two characters left out of either at most.
NORMAL = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"
CLOSE = FLEET + f""", miss AS (SELECT substr(known, 1, 6) || substr(known, 8, 1) || substr(known, 7, 1) || '9' AS raw FROM fleet),
    spelled AS (SELECT raw, count(*) AS mentions, {NORMAL.format('raw')} AS q FROM miss GROUP BY raw),
    ids AS (SELECT known, {NORMAL.format('known')} AS n FROM fleet),
    words AS (SELECT DISTINCT w FROM (SELECT q AS w FROM spelled UNION ALL SELECT n FROM ids)),
    one AS (SELECT w, substr(w, 1, i::INT - 1) || substr(w, i::INT + 1) AS s FROM words, unnest(range(1, length(w) + 1)) r(i)),
    two AS (SELECT w, substr(s, 1, i::INT - 1) || substr(s, i::INT + 1) AS s FROM one, unnest(range(1, length(s) + 1)) r(i)),
    subs AS (SELECT w, w AS s FROM words UNION SELECT * FROM one UNION SELECT * FROM two),
    lcs AS (SELECT a.w AS q, b.w AS n, max(length(a.s)) AS l FROM subs a JOIN subs b ON a.s = b.s GROUP BY 1, 2),
    close AS (SELECT raw, known, 200.0 * l / (length(q) + length(n)) AS score FROM spelled JOIN lcs USING (q) JOIN ids USING (n))"""


@query("dp17_misspelled_ids", "WITH " + CLOSE + """,
    exact AS (SELECT raw, count(*) AS hits, min(known) AS value, array_to_string(list_sort(list(known))[1:3], ',') AS options FROM spelled JOIN ids ON q = n GROUP BY 1),
    best AS (SELECT raw, count(*) FILTER (score >= 92) AS strong, array_to_string(list(known ORDER BY score DESC, known)[1:3], ',') AS near, arg_min(known, (-score, known)) AS top
             FROM close WHERE score >= 78 AND raw NOT IN (SELECT raw FROM exact) GROUP BY 1)
    SELECT s.raw, mentions, CASE WHEN hits = 1 THEN 'exact' WHEN hits > 1 THEN 'ambiguous' WHEN strong = 1 THEN 'fuzzy' WHEN near IS NOT NULL THEN 'ambiguous' ELSE 'not_found' END AS status,
           CASE WHEN hits = 1 THEN value WHEN hits IS NULL AND strong = 1 THEN top END AS value,
           CASE WHEN hits > 1 THEN options WHEN hits = 1 THEN '' WHEN strong = 1 THEN top ELSE coalesce(near, '') END AS suggestions
    FROM spelled s LEFT JOIN exact e ON e.raw = s.raw LEFT JOIN best b ON b.raw = s.raw""")
def misspelled_ids(t):
    out = matching.resolve(misspelled(t), fleet(t).select("known"))
    return out.select("raw", "mentions", "status", "value", F.array_join("suggestions", ",").alias("suggestions"))


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i::INT, 3)))))"


@query("so01_candidate_arms", "WITH " + FLEET + f""",
    raws AS (SELECT DISTINCT raw, regexp_replace(regexp_extract(raw, '([0-9]+)', 1), '^0+([0-9])', '\\1') AS digits, {TRIGRAMS.format('raw')} AS g
             FROM (SELECT substr(known, 1, 6) || substr(known, 8, 1) || substr(known, 7, 1) || '9' AS raw FROM fleet)),
    ids AS (SELECT known, {TRIGRAMS.format('known')} AS g FROM fleet),
    met AS (SELECT raw, known, any_value(digits) AS digits, count(*) AS shared, any_value(na) + any_value(nb) AS total
            FROM (SELECT raw, digits, len(g) AS na, unnest(g) AS gram FROM raws) JOIN (SELECT known, len(g) AS nb, unnest(g) AS gram FROM ids) USING (gram) GROUP BY 1, 2)""" + """
    SELECT raw, known, similarity, row_number() OVER (PARTITION BY raw ORDER BY lower(raw) = lower(known) DESC, similarity DESC, known) AS position
    FROM (SELECT raw, known, shared / (total - shared) AS similarity FROM met
          WHERE lower(raw) = lower(known) OR shared / (total - shared) >= 0.2 OR (digits <> '' AND contains(known, digits))) QUALIFY position <= 50""")
def candidate_arms(t):
    """The first 50 candidates of every misspelled id by case, trigrams and digits."""
    return matching.candidate_arms(misspelled(t), fleet(t).select("known"))


@query("sf23_fuzzy_ratio", r"""
    SELECT p_partkey, round(200.0 * length(w) / (length(w) + length(p_name)), 4) AS ratio
    FROM (SELECT p_partkey, p_name, substr(p_name, 3, 4 + (p_partkey % 9)::INT) AS w FROM part)""")
def fuzzy_ratio(t):
    """Names against a part of themselves: what both have is the part."""
    part = t.part.select("p_partkey", "p_name", F.expr("substr(p_name, 3, 4 + CAST(p_partkey % 9 AS INT))").alias("w"))
    return part.select("p_partkey", F.round(fuzzy.ratio(F.col("p_name"), F.col("w")), 4).alias("ratio"))


@query("ud05_fuzzy_scores")
def fuzzy_scores(t):
    """Both scores of question and answer over the whole conversation table."""
    rows = t.turns.where("answer IS NOT NULL")
    return rows.select("session_id", "turn_id", F.round(fuzzy.ratio(F.col("question"), F.col("answer")), 4).alias("ratio"),
                       F.round(fuzzy.token_set_ratio(F.lower("question"), F.lower("answer")), 4).alias("token_set"))


def question_cases(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.concat_ws("/", "lang", "source").alias("answer"))


@query("j14_near_duplicates")
def near_duplicates(t):
    """Documents of one language and source whose words nearly agree."""
    return matching.near_duplicates(question_cases(t), 95.0)


@query("j14_copies", r"""
    WITH w AS (SELECT doc_id, lang || '/' || source AS answer, array_to_string(list_sort(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '))), ' ') AS words FROM documents)
    SELECT min(doc_id) AS first_id, count(*) AS copies FROM w GROUP BY answer, words HAVING count(*) > 1""")
def copies(t):
    return matching.copies(question_cases(t)).select("first_id", "copies")


@query("j08_one_sided_hits", upto(CHUNKS, QUERIES, DENSE, SPARSE, FUSED) + """
    SELECT query_id, count(*) FILTER (dense_rank IS NULL) AS sparse_only, count(*) FILTER (sparse_rank IS NULL) AS dense_only,
           count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both_sides FROM fused GROUP BY 1""")
def one_sided_hits(t):
    """The full outer join of the two ranked lists: what each side found alone."""
    q, c = query_table(t), chunk_table(t)
    fused = search.fuse(search.dense_top_k(q, chunk_vectors(t), 50), search.sparse_top_k(q, c, 50))
    d, s = F.col("dense_rank"), F.col("sparse_rank")
    return fused.groupBy("query_id").agg(
        F.count(F.when(d.isNull(), 1)).alias("sparse_only"), F.count(F.when(s.isNull(), 1)).alias("dense_only"),
        F.count(F.when(d.isNotNull() & s.isNotNull(), 1)).alias("both_sides"))


@query("sf24_token_sets", r"""
    WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS words, list_distinct(string_split(p_name, ' ')[1:2]) AS kept FROM part),
    l AS (SELECT p_partkey, length(array_to_string(kept, ' ')) AS s, length(array_to_string(list_filter(words, lambda x: NOT list_contains(kept, x)), ' ')) AS a FROM w)
    SELECT p_partkey, round(greatest(CASE WHEN a = 0 THEN 100 ELSE 200.0 * s / (2 * s + 1 + a) END, 200.0 * s / (2 * s + 1 + 4),
        CASE WHEN a = 0 THEN 0 ELSE 200.0 * (s + 1) / (2 * s + 2 + a + 4) END), 4) AS token_set FROM l""")
def token_sets(t):
    """Names against their first two words, turned around, and a number: order and repeats don't count, the words that differ do."""
    words = F.split("p_name", " ")
    other = F.concat_ws(" ", F.lit("0000"), F.array_join(F.reverse(F.slice(words, 1, 2)), " "), words[0])
    return t.part.select("p_partkey", F.round(fuzzy.token_set_ratio(F.col("p_name"), other), 4).alias("token_set"))
