"""Chat formatting, spelling variants and periodic runs: against plain loops, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import chat_format, periodic_runs, queries, spelling

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_more|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<s>", "<|endoftext|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting


def chats(spark, rows, template=chat_format.Template()):
    out = chat_format.format_conversations(spark.createDataFrame(rows, TURNS), template)
    out = out.withColumn("turns", chat_format.read_back(F.col("formatted"), template)).withColumn(
        "learnt", chat_format.learnt_texts(F.col("formatted"), F.col("loss_spans"), template))
    return {r["conv_id"]: r for r in out.collect()}


def test_formatted_chats_read_back(spark):
    r = random.Random(3)
    bits = MARKS + ["\\", "\\\\", "<", "[", "|", ">", "é", "😀", "\n", " ", "word", "<\\|im_end|>", "<\\\\/s>", "﻿", ""]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "to<|im_sep|>ol"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8))))
            for c in range(150) for t in range(r.randint(1, 9))]
    r.shuffle(rows)
    got = chats(spark, rows)
    for c in range(150):
        own = sorted(x[1:] for x in rows if x[0] == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(role, text) for _, role, text in own]
        assert got[c]["learnt"] == [text for _, role, text in own if role == "assistant"]
        text = got[c]["formatted"]
        messages = 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
        assert got[c]["n_messages"] == text.count("<|im_start|>") == text.count("<|im_end|>") == text.count("<|im_sep|>") == messages
        assert text.count("<|im_more|>") == len(own) - messages
        assert not any(m in text for m in ("</s>", "<s>", "[INST]", "[/INST]", "<|endoftext|>"))


def test_formatted_chats_of_odd_rows(spark):
    rows = [(1, None, "user", None), (1, 2, None, "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 0, "assistant", "x"), (2, 0, "assistant", "")]
    got = chats(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", ""), ("", "b"), ("user", "a"), ("user", "a")]
    assert got[None]["learnt"] == ["x"] and got[2]["learnt"] == [""] and got[1]["learnt"] == []
    assert got[2]["formatted"] == "<|im_start|>assistant<|im_sep|><|im_end|>"
    assert chats(spark, []) == {}
    extra = spark.createDataFrame([(1, 0, "user", "a", 5, "z")], TURNS + ", formatted int, _turns string")
    assert chat_format.format_conversations(extra).first()["formatted"] == "<|im_start|>user<|im_sep|>a<|im_end|>"


def test_a_conversation_of_many_turns(spark):
    n = 20_000
    got = chats(spark, [(1, i, "assistant" if i % 3 else "user", f"t{i} é") for i in range(n)])[1]
    assert len(got["turns"]) == n and got["learnt"] == [f"t{i} é" for i in range(n) if i % 3]


def test_marks_that_could_hide_in_each_other_are_refused():
    for bad in ({"start": "<"}, {"end": "<\\x"}, {"head": "a<b"}, {"reserved": ("<s>", "s>")}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


# Spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, len(near))
    rows = {}
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, counts[w], near, counts[form] if form else None)
    return rows


def variants(spark, counts):
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcdé", 2), ("aaaab", 3)])
def test_variants_equal_brute_force(spark, letters, seed):
    r = random.Random(seed)
    counts = {}
    while len(counts) < 400:
        word = "".join(r.choice(letters) for _ in range(r.randint(4, 12)))
        for _ in range(r.randint(1, 4)):
            counts[word] = r.choice([3, 3, 6, 7, 12, 24, 100, 1000, 10 ** 6])
            at = r.randrange(len(word))
            word = word[:at] + r.choice(["", "", r.choice(letters), r.choice(letters) + word[at:at + 1]]) + word[at + 1:]
            if len(word) < 4:
                break
    assert variants(spark, counts) == plain_variants(counts)


def test_words_are_matched_without_gathering_them_on_the_driver(spark, tmp_path):
    spark.range(50).selectExpr("concat('word', id) AS word", "3 + id AS n").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for df in (spelling.near_pairs(words), spelling.variants(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_long_chain_ends_at_its_root(spark):
    counts = {"a" * (5 + i): 3 * 2 ** i for i in range(40)}
    got = variants(spark, counts)
    assert all(got[w][1] == "a" * 44 for w in counts) and got["a" * 44][0] is None and got["a" * 5][0] == "a" * 6


def test_ties_go_to_the_smallest_word(spark):
    got = variants(spark, {"aaaaa": 3, "aaaab": 9, "aaaaé": 9, "aaaac": 5})
    assert got["aaaaa"] == ("aaaab", "aaaab", 3, 3, 9) and got["aaaac"][0] is None


@given(st.text("abé", min_size=4, max_size=14), st.integers(0, 99), st.sampled_from(["", "a", "é"]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_one_edit_keeps_a_pivot(word, at, letter, put):
    at %= len(word) + put
    other = word[:at] + letter + word[at + (not put):]
    if other == word or len(other) < 4:
        return
    order = {g: i for i, g in enumerate(sorted({w[i:i + 2] for w in (word, other) for i in range(len(w) - 1)}, key=lambda g: zlib.crc32(g.encode())))}
    a, b = sorted((word, other), key=lambda w: spelling.prefix(w, order)[-1][0])
    assert any(spelling.kept_by_pivot(a, p) & {k for _, q in spelling.prefix(b, order) for k in spelling.kept_by_prefix(b, q)} for p in spelling.pivots(spelling.prefix(a, order)))


def plain_counts(rows, slips):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def test_vocabulary_and_slips(spark, monkeypatch):
    r = random.Random(5)
    words = ["Überall", "straße", "ÉTÉÉÉ", "naïve-ly", "x×y÷zab", "abcde", "ABCDE", "a", "日本abcdef", "don't", "trägt", "L’étéssss"]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", "s", "n"]) for _ in range(60))) for i in range(120)] + [(None, "abcde abcde"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for change in (None, queries.slipped):
        got = {x["word"]: x["n"] for x in spelling.vocabulary(docs, change).collect()}
        assert got == plain_counts(rows, change is not None)
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {x["word"]: x["n"] for x in spelling.vocabulary(docs).collect()} == plain_counts(rows, False)


def test_variants_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS + ", word string, n int")
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
    assert variants(spark, {"abc": 5, "abd": 50, "abcdefgh" * 500: 4, "abcdefgh" * 500 + "x": 40, None: 3}) == {
        "abc": (None, "abc", 5, 0, None), "abd": (None, "abd", 50, 0, None), None: (None, None, 3, 0, None),
        "abcdefgh" * 500: ("abcdefgh" * 500 + "x", "abcdefgh" * 500 + "x", 4, 1, 40), "abcdefgh" * 500 + "x": (None, "abcdefgh" * 500 + "x", 40, 1, None)}


# Periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(r, letters, n):
    out = []
    while len(out) < n:
        turn = [r.choice(letters) for _ in range(r.randint(1, 6))]
        out += turn * r.choice([1, 1, 3, 4, 5, 9]) + turn[:r.randint(0, len(turn))]
    return out[:n]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_runs_of_short_texts(texts):
    assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(i, r.choice([" ", "\t", "\n", "  "]).join(periodic(r, r.choice(["ab", "abcdefg", ["é", "日本", "x"]]), r.randint(0, 300)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t "), (None, "a a a a a a"), (None, "a a a a a a"), (303, "ha " * 5), (304, "a a a a " * 3), (305, "A a " * 3)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).withColumn("_text", F.lit(2)).repartition(3))
    found = Counter((x["doc_id"], x["n_words"], tuple(map(tuple, x["runs"])), x["collapsed"]) for x in got.collect())
    want = Counter()
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = plain_runs(words)
        want[doc_id, len(words), tuple(runs), plain_collapsed(words, runs)] += 1
    assert found == want
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_of_very_long_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 60_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for words, runs in ((["a"] * 100_000, [(0, 100_000, 1)]), (["a", "b", "c"] * 40_000 + ["a"], [(0, 120_001, 3)]), (list(fibonacci[-1]), []),
                        ([x for i in range(20_000) for x in ("a", "b", "c", "d", "e", str(i))], [])):
        assert periodic_runs.runs_of([[w.encode() for w in words]]) == [runs]


def test_the_query_of_runs(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randint(0, 200)))) for i in range(400)] + [(None, "a " * 9), (401, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.runs(spark, str(tmp_path)).collect()}
    repeated = 0
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            repeated += 1
        runs = plain_runs(words)
        x = got[doc_id]
        assert (x["n_runs"], x["runs_sha256"], x["collapsed_sha256"]) == (
            len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapsed(words, runs)))
        best = min(runs, key=lambda y: (-y[1], y[0], y[2]), default=(None, None, None))
        assert (x["start"], x["length"], x["period"]) == best
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert repeated > 20 and sum(bool(x["n_runs"]) for x in got.values()) > 10
