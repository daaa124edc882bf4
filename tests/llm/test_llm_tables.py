"""Operators that compare or order rows: against brute force, on planted groups and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import hamming_topk, hilbert, ngram_join, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


# Near duplicates


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(r, base, copies, most):
    """Copies of a text with some words replaced, dropped or put in."""
    words = base.split()
    for _ in range(copies):
        out = list(words)
        for _ in range(r.randint(0, max(1, int(len(words) * most)))):
            p = r.randrange(len(out)) if out else 0
            kind = r.random()
            if kind < 0.4 and out:
                out[p] = f"w{r.randrange(99)}"
            elif kind < 0.7 and out:
                del out[p]
            else:
                out.insert(p, f"x{r.randrange(99)}")
        yield " ".join(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(f"v{r.randrange(2000)}" for _ in range(n))
    shared, line = text(55), "licensed under the usual terms of this licence"
    rows = [text(r.choice([1, 2, 3, 5, 8, 9, 10, 12, 16, 20, 30, 60, 150, 400])) for _ in range(60)]
    for n in (6, 8, 9, 11, 14, 18, 22, 26, 33, 50, 120, 300):
        base = text(n)
        rows += [base, *family(r, base, 8, 0.05)]
    rows += [text(30) + " " + shared + " " + text(30) for _ in range(12)]
    rows += [text(r.randint(1, 4)) + " " + line for _ in range(25)]
    rows += [None, "", " \t\n ", "one", "ONE", "one two", "One\tTwo", "a b c", "a b c d", "A  b\nC d", "a b c d e", "é É b c", "É é b c", "x " * 5000, "x " * 4000, "a b c d e f", "a b c d e f"]
    rows += rows[:10] + ["hot copy of one text that many rows share"] * 40
    r.shuffle(rows)
    ids = list(range(100, 100 + len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    rows = corpus(seed)
    rows += [(None, rows[0][1]), (None, "a text of its own without id"), (rows[3][0], rows[3][1]), (rows[5][0], "the same id with another text")]
    docs = documents(spark, rows).withColumn("node", F.lit("clash")).withColumn("signatures", F.lit(1))
    got = [(x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(docs).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(plain_components(rows), key=order)


def test_join_of_nothing(spark):
    docs = documents(spark, [(1, "a b c d e")])
    assert ngram_join.near_duplicates(docs.where("false")).count() == 0
    assert [tuple(x)[:3] for x in ngram_join.near_duplicates(docs).collect()] == [(1, 2, 1)]
    assert [tuple(x)[:3] for x in ngram_join.near_duplicates(documents(spark, [(1, None), (None, "")])).collect()] in ([(1, 0, 1), (None, 0, None)], [(None, 0, None), (1, 0, 1)])


def test_keeping_one_of_each_group(spark):
    rows = corpus(3)
    rows += [rows[0], rows[0], (None, "alone without an id at all"), (None, rows[1][1])]
    docs = documents(spark, rows).withColumn("_node", F.lit("clash")).withColumn("_id", F.lit(0))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [x["doc_id"] for x in kept.collect()]
    truth = plain_components(rows)
    assert sorted(x for x in got if x is not None) == sorted({d for d, _, c in truth if d is not None and d == c}) and got.count(None) == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 400), st.floats(0, 0.2))
def test_linked_sets_share_a_signature(seed, n, change):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))
    gone = r.random(len(a)) < change * r.random()
    b = np.unique(np.concatenate((a[~gone], r.integers(0, 1 << 63, int(len(a) * change * r.random()), np.uint64))))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and both < len(np.union1d(a, b)):
        assert np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)).size


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 30))
def test_prefix_tree_counts_overlaps(seed):
    r = random.Random(seed)
    hub = sorted(r.sample(range(400), r.randint(1, 60)))
    sets = []
    for _ in range(25):
        s = set(hub)
        for _ in range(r.randint(0, 8)):
            s.symmetric_difference_update({r.randrange(400)})
        sets.append(sorted(s) or [1])
    sets += sets[:3] + [hub]
    want = [100 * len(set(hub) & set(s)) >= 85 * len(set(hub) | set(s)) for s in sets]
    assert ngram_join.linked(np.array(hub, np.uint64), [np.array(s, np.uint64) for s in sets]) == want


def test_sets_that_can_not_link_are_not_sent(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(f"v{r.randrange(9000)}" for _ in range(n))
    shared, base = text(90), text(120)
    rows = list(enumerate([text(30) + " " + shared + " " + text(30) for _ in range(60)] + [base, base + " new"]))
    made, cut = {}, ngram_join.cut

    def kept(df, name):
        made[name] = cut(df, name)
        return made[name]

    monkeypatch.setattr(ngram_join, "cut", kept)
    # One row comes twice: its set is sent once.
    got = ngram_join.near_duplicates(documents(spark, [*rows, rows[60]]), 5, 80).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: min(i, 60) for i, _ in rows}
    assert made["buckets"].select("node").distinct().count() > 30 and made["join-sets"].select("node").distinct().count() == 2


def test_stage_takes_edited_copies_for_one(spark):
    rows = []
    for n, places in ((100, (30, 60)), (200, (30, 70, 110, 150))):
        words = [f"t{n}w{i}" for i in range(n)]
        rows.append((n, " ".join(words)))
        rows.append((n + 1, " ".join("new" + w if i in places else w for i, w in enumerate(words))))
    docs = documents(spark, rows)
    assert [x["doc_id"] for x in ngram_join.near_duplicates(docs).where("component_id = doc_id").orderBy("doc_id").collect()] == [100, 101, 200, 201]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [100, 200]


@pytest.mark.parametrize("words, similar", [(5, 80), (2, 60)])
def test_join_is_exact_with_other_words_and_similarity(spark, words, similar):
    rows = corpus(4)
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.near_duplicates(documents(spark, rows), words, similar).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {d: (len(sets[d]), label[d]) for d in sets}


def test_shared_signatures_across_batches():
    import pyarrow as pa

    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(10), r.choice([-5, 2, 3, 1 << 62])) for _ in range(120)]
    nodes = {}
    for part, rest, node in rows:
        nodes.setdefault((part, rest), set()).add(node)
    want = sorted((p << 40 | s, n, min(nodes[p, s]), len(nodes[p, s])) for p, s in nodes if len(nodes[p, s]) > 1 for n in nodes[p, s])
    for size in (1, 2, 3, 7, 200):
        batches = []
        for i in range(0, len(rows), size):
            blocks = {}
            for part, rest, node in rows[i:i + size]:
                pair = np.zeros(1, ngram_join.PAIR)
                pair["rest"], pair["node"] = list(rest.to_bytes(5, "little")), node
                blocks[part] = blocks.get(part, b"") + pair.tobytes()
            batches.append(pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary())], ["part", "block"]))
        got = [x for b in ngram_join._buckets(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert got == want
    assert list(ngram_join._buckets(iter([]))) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(201, 200), (203, 202), (202, 201)]
    r = random.Random(1)
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = {x["node"]: x["label"] for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 204)}


# Shards


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = hilbert.curve_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 357])
def test_shards_are_even_and_in_order(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "hot text", f"text {r.random()}" * r.randint(1, 50), "ü😀"])) for i in range(n)]
    if n > 40:
        rows = rows[:-3] + [(None, "x"), rows[0], rows[0]]
    docs = documents(spark, rows).withColumn("n_chars", F.when(F.col("doc_id") % 7 > 0, F.col("n_chars"))).withColumn("shard", F.lit("clash"))
    got = hilbert.assign_shards(docs, 40).collect()
    assert len(got) == n
    counts = [sum(x["shard"] == s for x in got) for s in range(40)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(40):
        part = sorted((x["slot"], x["curve"]) for x in got if x["shard"] == s)
        assert [p for p, _ in part] == list(range(len(part))) and [c for _, c in part] == sorted(c for _, c in part)
    assert [x["curve"] for x in sorted(got, key=lambda x: (x["shard"], x["slot"]))] == sorted(x["curve"] for x in got)
    raw = sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert raw == sorted((x["doc_id"] is None, x["doc_id"] or 0, x["size"], x["text_crc32"]) for x in got)
    assert {x["law"] for x in got} <= {"rows"} and {x["grown_shard"] for x in got} <= {None}


def test_written_shards_prune(spark, tmp_path):
    docs = documents(spark, [(i, "t" * (i * 37 % 900)) for i in range(400)])
    assigned = hilbert.assign_shards(docs, 8)
    hilbert.write_shards(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 400 and back.select("_shard").distinct().count() == 8
    spread = back.groupBy("_shard").agg((F.max("n_chars") - F.min("n_chars")).alias("n"), F.count_distinct("source").alias("s")).collect()
    assert min(x["n"] for x in spread) < 500 and min(x["s"] for x in spread) < 3


def test_sources_of_a_common_prefix_are_told_apart(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                    F.format_string("https://host%02d.example", F.col("id") % 50).alias("source"), F.lit(1).alias("n_chars"))
    place = docs.select("doc_id", "source")
    per = hilbert.assign_shards(docs, 25).join(place, "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert len(per) == 25 and max(x["n"] for x in per) <= 4
    bins = {x["value"]: x["bin"] for x in hilbert.value_bins(docs.withColumn("source", F.when(F.col("doc_id") > 9, F.col("source"))), "source").collect()}
    values = sorted(bins)
    assert len(values) == 50 and all(abs(bins[v] - i * 64 / 50) <= 2 for i, v in enumerate(values)) and [bins[v] for v in values] == sorted(bins.values())


# Nearest codes


def plain_nearest(rows, asked, k):
    out = []
    for q, a in sorted(set(asked)):
        near = sorted(((a ^ b) & ((1 << 64) - 1)).bit_count() * (1 << 40) + d for d, b in set(rows) if d != q)[:k]
        out += [(q, n + 1, x % (1 << 40), x >> 40) for n, x in enumerate(near)]
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_codes_are_exact(spark, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(260):
        code = r.choice(centres)
        for _ in range(r.choice([0, 1, 2, 5, 9, 20])):
            code ^= 1 << r.randrange(64)
        rows.append((i, signed(code)))
    rows += [(1000 + i, signed(centres[0])) for i in range(120)] + [rows[0]]
    asked = [x for x in rows if x[0] % 20 == 0]
    schema = "vec_id long, code long"
    odd = spark.createDataFrame([(None, 1), (5000, None)], schema)
    table = spark.createDataFrame(rows, schema).union(odd).withColumn("id", F.lit("clash")).withColumn("distance", F.lit(0))
    got = hamming_topk.top_k(table, spark.createDataFrame(asked, schema).union(odd), 10).collect()
    assert sorted(tuple(x) for x in got) == plain_nearest(rows, asked, 10)


def test_few_codes_and_none(spark):
    schema = "vec_id long, code long"
    rows = [(1, 0), (2, 1), (3, signed((1 << 64) - 1))]
    table = spark.createDataFrame(rows, schema)
    assert sorted(tuple(x) for x in hamming_topk.top_k(table, table.where("vec_id = 1"), 2).collect()) == [(1, 1, 2, 1), (1, 2, 3, 64)]
    assert hamming_topk.top_k(table.where("false"), table, 2).count() == 0
    assert hamming_topk.top_k(table, table.where("false"), 2).count() == 0


def test_sign_codes(spark):
    vectors = [[1.0, -1.0, 0.0] + [-0.5] * 61, None, [], [1.0, None], [-1.0] * 63 + [2.0], [2.0] * 64]
    got = spark.createDataFrame([(v,) for v in vectors], "v array<float>").select(hamming_topk.sign_code(F.col("v")).alias("c")).collect()
    assert [x["c"] for x in got] == [5, None, None, None, signed(1 << 63), -1]
    with pytest.raises(Exception, match="more than 64 dimensions"):
        spark.createDataFrame([([2.0] * 70,)], "v array<float>").select(hamming_topk.sign_code(F.col("v"))).collect()


# All together


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    folder = str(tmp_path)
    english = "the house and river with those who were there that night on other side of world near old bridge where people walk slowly home".split()
    text = lambda n: " ".join(r.choice(english) + ("" if r.random() < 0.9 else ",") for _ in range(n))
    item = " ".join(f"{w} of" for w in english[:20])
    base = text(120)
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, text(60)) for i in range(40)] + [(50, base), (51, base), (52, base + " home"), (60, text(20) + " . " + item + " . " + text(20)), (70, text(30) + f' token = "{secret}" ' + text(30)), (80, "12 34 !!"), (81, None)]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {*range(40), 50, 70}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {x["doc_id"]: x for x in docs.collect()}
    assert secret not in kept[70]["text"] and kept[70]["n_chars"] == len(kept[70]["text"]) and kept[50]["text"] == base
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_one_query_for_each_operator():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_stages_get_small_batches(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a text", "en", "src1")], "doc_id long, text string, lang string, source string")
    texts = spark.range(0, 24, 1, 1).select(F.expr("repeat('ab ', 350000 + cast(id as int))").alias("text"))

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        corpus_pipeline.benchmark(spark, docs, str(tmp_path))
        assert texts.mapInArrow(largest, "n long").first()["n"] < 10 << 20  # 24 MB in one batch without the setting
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
