"""Runs of words that repeat with a period, in every whole text.

Maximal-pair enumeration: two equal stretches that can be extended neither to the left nor to the right, at a distance d
and of a length l >= 3d, are a run of period d and length l + d, with no extension needed. The suffixes of a text that
share five words with another one are sorted; a walk over their common prefixes closes the intervals of the LCP tree from the
deepest up. An interval keeps its places in order, each with its left word as class. Where children meet, places of
different children and classes are pairs. The first two turns of a run have no third place of their interval between
them (it would be a shorter period), so only neighbours are looked at: an interval with thousands of classes costs no more."""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.frames import slices

#: A run has at least so many words, and so many turns.
LEAST_LENGTH = 6
TURNS = 4
#: Words that the pair of a run shares at least: five at distance 1, six at 2, more beyond.
LEAST_SHARED = min(max(LEAST_LENGTH - d, (TURNS - 1) * d) for d in range(1, LEAST_LENGTH))
#: Bytes of text whose suffixes a worker sorts together; a longer text is alone.
SLICE_BYTES = 1 << 19

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
    """A number for every word, other ones in each text, and where each text begins. A number that occurs once ends each text."""
    out: list[int] = []
    starts: list[int] = []
    free = itertools.count()
    for words in texts:
        starts.append(len(out))
        own: defaultdict[bytes, int] = defaultdict(free.__next__)
        out += [own[w] for w in words]
        out.append(next(free))
    return np.array(out, dtype=np.int64), starts


def sorted_suffixes(words: np.ndarray, least: int = LEAST_SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Places of suffixes in order, and how many words each shares with the one before it. All suffixes that share `least`
    words or more with another one are among them.

    Prefix doubling, where a place drops out of the sort as soon as nothing else begins like it. The ranks of each
    doubling are kept, and the shared words are found by going back through them."""
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words]
    live = np.flatnonzero(counts[words] > 1)
    levels: list[np.ndarray] = []
    some, width = np.zeros(0, dtype=np.int64), 1
    while len(live):
        levels.append(rank.astype(np.int32) if len(rank) < 1 << 31 else rank)
        if width <= least < 2 * width:
            some = live
        # A live place shares `width` words with another, so its text does not end within them.
        pair = rank[live] * np.int64(len(words)) + rank[live + width]
        order = np.argsort(pair, kind="stable")
        live, pair = live[order], pair[order]
        block, at = rank[live], np.arange(len(live))
        new, opens = np.ones(len(live), dtype=bool), np.ones(len(live), dtype=bool)
        new[1:], opens[1:] = pair[1:] != pair[:-1], block[1:] != block[:-1]
        rank = rank.copy()
        rank[live] = block + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
        alone = new & np.append(new[1:], True)
        live, width = live[~alone], 2 * width

    if not len(some):
        return some, some
    some = some[np.argsort(rank[some], kind="stable")]
    a, b = some[:-1], some[1:]
    for i in range(len(levels) - 1, -1, -1):
        step = np.where(levels[i][a] == levels[i][b], 1 << i, 0)
        a, b = a + step, b + step
    return some, np.append(0, a - some[:-1])


def _joined(left: list[int], right: list[int], words: list[int], shared: int, found: list[Run]) -> list[int]:
    """The places of two children of an interval as one ordered list. Neighbours of different children and
    left words are maximal pairs; those near enough to be a run go to `found`."""
    into, more = (left, right) if len(left) >= len(right) else (right, left)
    own = set(more)
    if 8 * len(more) < len(into):
        for p in more:
            bisect.insort(into, p)
        at = [bisect.bisect_left(into, p) for p in more]
    else:
        into = sorted(into + more)
        at = [i for i, p in enumerate(into) if p in own]
    for i in at:
        for k in (i, i + 1):  # the neighbours k - 1 and k
            if 0 < k < len(into):
                x, y = into[k - 1], into[k]
                d = y - x
                if (TURNS - 1) * d <= shared and LEAST_LENGTH <= shared + d and words[x - 1] != words[y - 1] and (x in own) != (y in own):
                    found.append((x, shared + d, d))
    return into


def maximal_pairs(places: list[int], common: list[int], words: list[int], least: int = LEAST_SHARED) -> list[Run]:
    """The runs among suffixes in order, as start, length, period: the LCP-interval tree from the bottom up. An open
    interval on the stack has its shared words and the places of its children so far."""
    found: list[Run] = []
    open_: list[tuple[int, list[int]]] = []
    child: list[int] = []
    for place, shared in zip([*places, -1], [*common, 0]):
        while open_ and open_[-1][0] > shared:
            length, held = open_.pop()
            child = _joined(held, child, words, length, found)
        if shared >= least:
            if open_ and open_[-1][0] == shared:
                open_[-1] = (shared, _joined(open_[-1][1], child, words, shared, found))
            else:
                open_.append((shared, child))
        child = [place]
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words, by start, then period."""
    words, starts = numbered(texts)
    places, common = sorted_suffixes(words)
    out: list[list[Run]] = [[] for _ in texts]
    if len(places):
        for start, length, period in sorted(maximal_pairs(places.tolist(), common.tolist(), words.tolist()), key=lambda r: (r[0], r[2])):
            k = bisect.bisect_right(starts, start) - 1
            out[k].append((start - starts[k], length, period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that some run contains after its first period, joined by one space."""
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every whole text.

    Words are what is between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns. A run is a stretch with its smallest period, of
    `LEAST_LENGTH` words and `TURNS` periods at least, that no neighbouring word continues. `collapsed` has each run's
    first period alone. Texts stay in their task, a bounded slice at a time; a longer text is a slice of its own, and
    takes some hundred bytes a word.

    A null or empty text has no words, no runs and an empty `collapsed`. Null ids stay null, repeated rows give repeated results,
    other columns are not read. An empty table gives an empty result."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
                words = [t.split() for t in texts[a:b].cast(pa.binary()).to_pylist()]
                found = runs_of(words)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array(map(len, words), pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], RUNS),
                    pa.array([collapsed(w, r).decode() for w, r in zip(words, found)], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
