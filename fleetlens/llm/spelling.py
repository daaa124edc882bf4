"""Groups of spelling variants over the vocabulary of all documents.

Pivotal grams: the two-letter grams of the vocabulary are ordered, rare ones first. A word's prefix is its three first grams
(and whatever ties with the third); one edit leaves one of any two grams that don't overlap, so of two words one edit
apart, the one whose third gram comes first has a pivot in the other's prefix. The edit is on one side of that pivot: the
other side is the same in both, and of a side cut into three all parts but one. Pivots and prefixes meet on what stays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.frames import cut, slices

#: Words are runs of ASCII letters and of U+00C0 to U+00FF, here in UTF-8 after A-Z were lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Two letters a gram, and one edit reaches two grams: three grams hold two that don't overlap.
GRAM, PREFIX = 2, 3
#: Parts of the side of a pivot that holds the edit.
PARTS = 3
#: A word is a form of another that is so many times as frequent.
TIMES = 2
#: Distinct words a task counts before it hands them on.
HELD = 200_000
#: For joins with what is made of the vocabulary. Spark takes their size from the few stored bytes of the words, before these become many keys
#: each, and would gather them on the driver.
SHUFFLED = "merge"

Change = Callable[[object, list[bytes]], list[bytes]]


def vocabulary(docs: DataFrame, change: Change | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all whole texts with at least `least_length` code points and `least_count` occurrences.

    `change` may alter the words (UTF-8, lower-cased) of a document. Each task sums its words up before the shuffle, handing
    on what it holds whenever there are `HELD` distinct ones; a word of a third of all occurrences is a row a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            long = [w for w in held if len(w) - w.count(b"\xc3") >= least_length]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in long], pa.string()), pa.array([held[w] for w in long], pa.int64())], ["word", "n"])

        for batch in batches:
            texts = batch.column("_text")
            for a, b in slices(pc.binary_length(texts).to_pylist()):
                ids, whole = batch.column("_id")[a:b].to_pylist(), texts[a:b].cast(pa.binary()).to_pylist()
                for doc_id, text in zip(ids, whole):
                    # bytes.lower knows A-Z only
                    words = RUN.findall(text.lower())
                    held.update(change(doc_id, words) if change else words)
                    if len(held) > HELD:
                        yield rows()
                        held.clear()
        yield rows()

    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """The rank of every gram, rarest first. There are at most as many as pairs of the 90 letters: 8,100 rows, whatever the input."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") >= GRAM).select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the first three grams, and of all that tie with the third."""
    grams = sorted((order[word[i:i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    return [g for g in grams if g[0] <= grams[PREFIX - 1][0]]


def pivots(grams: list[tuple[int, int]], weights: list[int] | None = None) -> list[int]:
    """Places of two grams that don't overlap and whose ranks add up to the least: along the word, the best single gram
    that ended before each place is kept, and each gram is taken with it."""
    single: tuple[int, int] | None = None
    best: tuple[int, int, int] | None = None
    waiting: list[tuple[int, int]] = []
    for rank, at in sorted(grams, key=lambda g: g[1]):
        while waiting and waiting[0][1] <= at - GRAM:
            single = min(single or waiting[0], waiting[0])
            waiting.pop(0)
        if single:
            best = min(best or (single[0] + rank, single[1], at), (single[0] + rank, single[1], at))
        waiting.append((rank, at))
    return [best[1], best[2]]


def _cuts(n: int) -> list[int]:
    return [n * i // PARTS for i in range(PARTS + 1)]


def kept_by_pivot(word: str, at: int) -> set[tuple]:
    """What of a word is the same in its neighbour if the pivot at `at` stays: the pivot with one side,
    and of the other side all parts but one."""
    out, n, after = set(), len(word), at + GRAM
    right, left = _cuts(n - after), _cuts(at)
    for a, b in zip(right, right[1:]):
        out.add((1, at, word[:after + a], word[after + b:]))
    for a, b in zip(left, left[1:]):
        out.add((0, n - at, word[:a], word[b:]))
    return out


def kept_by_prefix(word: str, at: int) -> set[tuple]:
    """The same from the other word's side, for every length its neighbour may have. The places agree: counted from
    the start where the edit comes after the pivot, else from the end."""
    out, n, after = set(), len(word), at + GRAM
    for more in (-1, 0, 1):
        right, left = n - after + more, at + more
        if right >= 0:
            cuts = _cuts(right)
            out.update((1, at, word[:after + a], word[n - (right - b):]) for a, b in zip(cuts, cuts[1:]) if a + right - b <= n - after)
        if left >= 0:
            cuts = _cuts(left)
            out.update((0, n - at, word[:a], word[at - (left - b):]) for a, b in zip(cuts, cuts[1:]) if a + left - b <= at)
    return out


def _digest(key: tuple) -> int:
    side, place, head, tail = key
    return xxhash.xxh64_intdigest(f"{side} {place} {head} {tail}") - (1 << 63)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both ways, all words of the table that one inserted, deleted or replaced code point
    makes equal. words: word (distinct, at least four code points), n.

    Keys are 64-bit digests of what stays; what meets is compared letter by letter, so that digests decide nothing. No
    pair is left out, and words that only share a common gram, stem or ending never meet: all but a third of one side has to agree."""
    order = gram_order(words)

    def keys(own: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    found, rows, last = [], [], []
                    for i, word in enumerate(part.column("word").to_pylist()):
                        grams = prefix(word, order)
                        places, kept = (pivots(grams), kept_by_pivot) if own else ([p for _, p in grams], kept_by_prefix)
                        mine = {_digest(key) for at in places for key in kept(word, at)}
                        found += mine
                        rows += [i] * len(mine)
                        last += [grams[-1][0]] * len(mine)
                    take = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.int64()), part.column("word").take(take), part.column("n").take(take), pa.array(last, pa.int32())], ["key", "word", "n", "last"])

        return words.mapInArrow(of, "key long, word string, n long, last int")

    a, b = keys(True), keys(False).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    met = a.join(b.hint(SHUFFLED), "key").where("last <= other_last AND word <> other AND abs(length(word) - length(other)) <= 1")
    near = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    back = near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return near.unionByName(back).distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. words: word (distinct), n.

    A word's form is its near word with the largest n (ties: the smallest in code-point order) if that is at least twice
    the word's n. The root is where following forms ends, the word itself if it has none. Each step doubles n at least, so a chain
    has at most log2 of the largest n steps, and taking twice as long steps each time ends after log2 of that.

    A word has at most some 180 near words for each of its letters, so no group grows with the input. Words under four code
    points and nulls have no near words. An empty table gives an empty result."""
    words = cut(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words.where(F.length("word") > GRAM + 1))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    per = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    formed = words.join(per.hint(SHUFFLED), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("_best.less") >= TIMES * F.col("n"), F.struct(F.col("_best.other").alias("form"), (-F.col("_best.less")).alias("form_n"))).alias("_f"))
    formed = cut(formed.select("word", "n", "n_near", F.col("_f.form").alias("form"), F.col("_f.form_n").alias("form_n")), "forms")

    most = formed.agg(F.max("form_n")).first()[0] or 1
    steps = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reached = 1
    while reached < int(most).bit_length():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = cut(steps.join(further.hint(SHUFFLED), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        reached *= 2
    return formed.join(steps.hint(SHUFFLED), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
