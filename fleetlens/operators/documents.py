"""From raw documents and pages to stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens import session
from fleetlens.functions import html, markdown, text
from fleetlens.operators import skew
from fleetlens.sources.stored import Stored


def ingest_status(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """DP1: what becomes of each incoming document (doc_id, raw) against the
    stored ones (doc_id, content_hash).

    Of equal new documents the one with the lowest id is taken. The choice is an
    aggregate per hash, and its outcome is joined back on doc_id, which is
    unique: a text with many copies gathers nowhere. The texts are hashed once,
    into a narrow table."""
    return hash_status(hashed(incoming), stored)


def hashed(incoming: DataFrame) -> DataFrame:
    """The hashes of incoming documents, written out: doc_id, content_hash."""
    return session.cut(incoming.select("doc_id", text.content_hash(F.col("raw")).alias("content_hash")), "hashes")


def hash_status(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """DP1 for documents whose hashes are known: doc_id, content_hash."""
    docs = hashes.withColumn("_blank", F.col("content_hash") == F.sha2(F.lit(""), 256))
    first = docs.where("NOT _blank").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    fresh = first.join(stored.select("content_hash").distinct(), "content_hash", "left_anti").select(
        "doc_id", F.lit(True).alias("_fresh"))
    known = stored.select("doc_id", F.lit(True).alias("_known"))
    status = (F.when(F.col("_blank"), "failed").when(F.col("_fresh").isNull(), "skipped_duplicate")
              .when(F.col("_known"), "replaced").otherwise("ingested"))
    return docs.join(fresh, "doc_id", "left").join(known, "doc_id", "left").select("doc_id", "content_hash", status.alias("status"))


def resolve_metadata(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """DP2/IO7: title, domain, models, date and trust of a document: the caller's
    column first, then the front matter, then the default; `error` names what is wrong. A bad
    document is a row with an error, never the end of the job."""
    meta, body = text.front_matter(F.col(raw))
    docs = docs.withColumn("_meta", meta).withColumn("body", body)

    def pick(name, default):
        given = [F.col(name)] if name in docs.columns else []
        return F.coalesce(*given, F.col("_meta")[name], default)

    out = docs.select(
        *[c for c in docs.columns if c not in ("_meta", "title", "domain", "doc_type", "trust", "uploaded_by")],
        pick("title", F.col("doc_id").cast("string")).alias("title"),
        pick("domain", F.lit(None).cast("string")).alias("domain"), pick("doc_type", F.lit("document")).alias("doc_type"),
        pick("trust", F.lit("internal")).alias("trust"), pick("uploaded_by", F.lit("unknown")).alias("uploaded_by"), text.as_list(F.col("_meta")["applies_to_models"]).alias("applies_to_models"),
        text.as_date(F.col("_meta")["effective_date"]).alias("effective_date"))
    wrong = (F.when(F.col("domain").isNull() | ~F.col("domain").isin(ref.DOMAINS), "unknown domain")
             .when(~F.col("trust").isin(ref.TRUST_LEVELS), "unknown trust level")
             .when(text.strip(F.coalesce("body", F.lit(""))) == "", "no content"))
    return out.withColumn("error", wrong)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """DP4/DP7: (doc_id, title, body) -> one row per chunk, in order, with the
    error codes that its own text names, not its title, section or caption. No shuffle: a document is one row."""
    found = docs.withColumn("_chunks", markdown.split_chunks(F.col("body"), F.col("title")))
    rows = found.select("doc_id", F.posexplode("_chunks").alias("position", "_c"))
    return rows.select("doc_id", "position", "_c.*", text.codes(F.col("_c.body")).alias("error_codes")).drop("body")


def lookup_table(keys):
    """DP5: an array of first cells is a lookup table's: all keys, all distinct."""
    return (F.size(keys) > 0) & (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(
        keys, lambda k: k.rlike(ref.LOOKUP_KEY_PATTERN))


def promote_codes(docs: DataFrame, by_document: bool = False) -> DataFrame:
    """DP6: rows of every table that has a code and a meaning column, under
    canonical names. A code defined twice keeps its last definition: of all documents, or of each one with `by_document`,
    where documents are manuals of their own that use the same codes."""
    blocks = docs.select("doc_id", F.posexplode(markdown.parse_blocks(F.col("body"))).alias("_block", "b")).where("b.kind = 'table'")
    names = F.create_map(*[F.lit(x) for kv in ref.CODE_COLUMNS.items() for x in kv])
    headers = F.transform("b.headers", lambda h: F.coalesce(F.try_element_at(names, text.column_key(h)), F.lit("")))
    tables = blocks.select("doc_id", "_block", headers.alias("h"), F.col("b.rows").alias("rows")).where(
        F.array_contains("h", "code") & F.array_contains("h", "meaning"))
    rows = tables.select("doc_id", "_block", "h", F.posexplode("rows").alias("_row", "cells"))

    def cell(name):
        matches = F.filter(F.arrays_zip(F.col("h"), F.col("cells")), lambda z: (z["h"] == name) & (z["cells"] != ""))
        return F.try_element_at(matches, F.lit(-1))["cells"].alias(name)

    wide = rows.select("doc_id", "_block", "_row", *[cell(c) for c in ("code", "subsystem", "meaning", "recommended_action", "severity")])
    valid = wide.where(text.codes(F.col("code")) == F.array(F.col("code"))).where(F.col("meaning").isNotNull())
    values = F.struct("subsystem", "meaning", "recommended_action", "severity", F.col("doc_id").alias("source_document"))
    last = valid.groupBy("code", *(["doc_id"] if by_document else [])).agg(F.max_by(values, F.struct("doc_id", "_block", "_row")).alias("v"))
    return last.select("code", "v.*")


def embedding_spaces(chunks: DataFrame) -> DataFrame:
    """DP9: the dimensions found among the stored vectors."""
    return chunks.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("dimensions")).agg(
        F.count(F.lit(1)).alias("chunks"))


def same_space(chunks: DataFrame, dimensions: int) -> DataFrame:
    """DP9: the chunks, or an error while the job runs if any vector has another size."""
    ok = F.size("embedding") == dimensions
    return chunks.where(F.when(ok, True).otherwise(F.raise_error(F.lit("vectors of another model are stored"))))


def store_vectors(vectors: DataFrame, path: str, model: str, dimensions: int, buckets: int = 64) -> Stored:
    """DP8: a stored table of vectors (doc_id, embedding) that remembers their model and size."""
    return Stored.create(same_space(vectors, dimensions), path, ["doc_id"], buckets, {"model": model, "dimensions": dimensions})


def vectors_of(table: Stored, model: str) -> DataFrame:
    """DP9: the stored vectors, for a caller whose questions are encoded by `model`."""
    if table.properties["model"] != model:
        raise ValueError(f"the vectors are of {table.properties['model']}, not of {model}: encode all documents anew first")
    return table.read()


def add_vectors(table: Stored, vectors: DataFrame, model: str) -> Stored:
    """DP9: new and changed documents' vectors, refused if another model made them."""
    vectors_of(table, model)
    return table.upsert(same_space(vectors, table.properties["dimensions"]), ["embedding"])


def reembed(table: Stored, vectors: DataFrame, model: str, dimensions: int) -> Stored:
    """DP8: all documents under a new model. They are written beside the old ones and switched to in one step, and only if every
    stored document has a new vector: until then, and after a failure, readers see the old model's."""
    fresh = session.cut(same_space(vectors, dimensions), "vectors")
    missing = table.read().select("doc_id").join(fresh.select("doc_id"), "doc_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("stored documents without a new vector")
    return table.replace_all(fresh, model=model, dimensions=dimensions)


def read_pages(pages: DataFrame) -> DataFrame:
    """IO13: title, text and tables of each page."""
    return pages.withColumn("_p", html.extract_page(F.col("html"))).select("page_id", "url", "_p.*")


def keep_last_lines(lines):
    """Each line only where it occurs last; an array expression, linear."""
    return F.reverse(F.array_distinct(F.reverse(lines)))


def normal_url(url):
    return F.rtrim(F.trim(url), F.lit("/"))


def clean_pages(pages: DataFrame, sources: DataFrame, replacements: dict[str, str], guard: list[str]) -> DataFrame:
    """DP37/J22: page text without furniture and repeated lines, terms replaced;
    a page that still holds a guarded term is refused. Pages whose address is
    not configured, or set to skip, are left out."""
    configured = sources.where("NOT skip").select(normal_url(F.col("url")).alias("_site"), "domain")
    body = F.array_join(keep_last_lines(text.content_lines(F.col("text"))), "\n\n")
    rows = pages.withColumn("_site", normal_url(F.col("url"))).join(skew.small(configured, 100_000), "_site").select(
        "page_id", "domain", text.replace_terms(text.strip(F.col("title")), replacements, whole=True).alias("title"),
        text.replace_terms(body, replacements, whole=True).alias("body"))
    left = text.remaining_terms(F.concat("title", "body"), guard)
    return rows.withColumn("left_terms", left).withColumn(
        "status", F.when(F.size("left_terms") > 0, "refused").otherwise("written"))


def find_terms(chunks: DataFrame, terms: DataFrame, max_terms: int = 10_000, max_bytes: int = 16 << 20) -> DataFrame:
    """DP30: where a term (trap_id, term) stands in a text (doc_id, content) as
    whole words, any case, with 50 characters around the first match.

    A text can hold a term only if it holds the term's longest word, so only
    those pairs are tested. While the list has at most `max_terms` terms and `max_bytes` bytes these
    words go to every task as one array and the texts stay where they are; a
    longer list is joined on the word and the texts are shuffled."""
    keyed = terms.select("trap_id", F.trim("term").alias("term")).withColumn("_words", text.tokens(F.col("term"))).where(
        F.size("_words") > 0).select("trap_id", "term", F.array_max(F.transform(
            "_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    rows, size = keyed.limit(max_terms + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if rows <= max_terms and size <= max_bytes:
        listed = keyed.agg(F.collect_set("word")).scalar()
        held = chunks.select("doc_id", "content", F.explode(F.array_intersect(text.tokens(F.col("content")), listed)).alias("word"))
        near = held.join(F.broadcast(keyed), "word")
    else:
        words = chunks.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("word"))
        near = chunks.select("doc_id", "content").join(words.join(keyed, "word").drop("word"), "doc_id")
    whole = F.concat(F.lit(r"(?<!\w)\Q"), F.col("term"), F.lit(r"\E(?!\w)"))
    hit = near.where(F.contains(F.lower("content"), F.lower("term"))).where(F.rlike("content", F.concat(F.lit("(?isU)"), whole)))
    around = F.call_function(
        "regexp_extract", F.col("content"), F.concat(F.lit("(?isU).{0,50}"), whole, F.lit(".{0,50}")), F.lit(0))
    return hit.select("trap_id", "term", "doc_id", text.squash(around).alias("context"))


def question_overlap(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """DP31: the largest share of a question's words found in one chunk of its
    own document: questions (case_id, doc_id, question), chunks (doc_id, content)."""
    q = questions.withColumn("_words", text.content_words(F.col("question")))
    c = chunks.select("doc_id", text.content_words(F.col("content")).alias("_has"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_words", "_has")), F.size("_words")), F.lit(0.0))
    return q.join(c, "doc_id", "left").groupBy("case_id").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("overlap"))
