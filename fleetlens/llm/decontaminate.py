"""Benchmark items in documents, also with other numbers, names or units in their slots."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.frames import text_slices

#: Tokens of a window; tokens of an item that have to be found before it counts: half of the item, but not
#: fewer than a window nor more than ENOUGH.
WINDOW, ENOUGH = 8, 13
#: Items with fewer tokens have to stand in the text with their own values.
LEAST = 4
#: An index above this is not handed to the workers.
MOST_BYTES = 256 << 20

#: Words that are a unit where they follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl dl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz v w kw j kj n pa kpa c f k percent degrees dollars cents euros usd eur"
).split()

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_PLAIN, _NAME, _NUMBER, _BREAK = 0, 1, 2, 3
_SLOT = {_NAME: 0x9D39247E33776D40, _NUMBER: 0x2AF7398005AAA5C4, 4: 0x44DB015024623544}


class _Words(dict):
    """A token's 64-bit value, its kind in the last two bits; forgets all at a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        if word[0].isdigit():
            value = _NUMBER
        elif word in ".!?\n":
            value = _BREAK
        else:
            value = xxhash.xxh3_64_intdigest(word.lower().encode()) & ~3 | (word[0].isupper() and word[1:].islower())
        self[word] = value
        return value


_words = _Words()
_UNIT_VALUES = np.sort(np.array([xxhash.xxh3_64_intdigest(u.encode()) & ~3 for u in UNITS], np.uint64))
_POWER = np.array([pow(0x9E3779B97F4A7C15, WINDOW - 1 - i, 1 << 64) for i in range(WINDOW)], np.uint64)


class Canonical:
    """A text as tokens in two forms: `plain` types numbers and their units, `named` types names too
    (capitalised words inside a sentence)."""

    def __init__(self, text: str):
        found = _TOKEN.findall(text)
        values = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
        kind = (values & np.uint64(3)).astype(np.int8)
        token = kind != _BREAK
        starts = np.ones(len(values), bool)
        starts[1:] = kind[:-1] == _BREAK
        self.found, self.at = found, np.nonzero(token)[0]
        kind, starts = kind[token], starts[token]
        plain = values[token] & ~np.uint64(3)
        number = kind == _NUMBER
        unit = np.zeros(len(plain), bool)
        if number.any():
            after = np.nonzero(number[:-1])[0] + 1
            after = after[~number[after] & ~starts[after]]
            unit[after] = np.isin(plain[after], _UNIT_VALUES)
        self.kind = np.where(number, _NUMBER, np.where(unit, 4, 0)).astype(np.int8)
        self.plain = np.where(number, np.uint64(_SLOT[_NUMBER]), np.where(unit, np.uint64(_SLOT[4]), plain))
        name = (kind == _NAME) & ~starts & ~unit
        self.named_kind = np.where(name, _NAME, self.kind).astype(np.int8)
        self.named = np.where(name, np.uint64(_SLOT[_NAME]), self.plain) if name.any() else self.plain
        self._values, self._numbers = values[token], np.nonzero(number)[0]

    @property
    def exact(self) -> np.ndarray:
        """A third form, without placeholders."""
        out = self._values & ~np.uint64(3)
        for i in self._numbers.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.surface(i).encode())
        return out

    def __len__(self) -> int:
        return len(self.plain)

    def surface(self, i: int) -> str:
        return self.found[self.at[i]]


def windows(values: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A hash of each run of `width` tokens."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += values[i:i + n] * _POWER[WINDOW - width + i]
    return total ^ (total >> np.uint64(29))


class Index:
    """Windows of all items by hash; short items are one window of their own width. Windows with more slots than words, and
    items under LEAST tokens, are found by their own values only."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, Canonical(t)) for i, t in items]
        rows: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        for k, (_, c) in enumerate(self.items):
            width = min(WINDOW, len(c))
            if not width:
                continue
            typed = lambda kinds: (np.convolve(kinds == 0, np.ones(width, int), "valid") * 2 >= width) & (width >= LEAST)
            for values, kinds in {id(c.plain): (c.plain, c.kind), id(c.named): (c.named, c.named_kind)}.values():
                literal = typed(kinds)
                rows.setdefault((width, False), []).extend((int(h), k, p) for p, h in enumerate(windows(values, width)) if literal[p])
            literal = typed(c.kind)  # what is equal without placeholders is equal in the plain form
            if not literal.all():
                rows.setdefault((width, True), []).extend((int(h), k, p) for p, h in enumerate(windows(c.exact, width)) if not literal[p])
        self.tables = {}
        for key, found in rows.items():
            if not found:
                continue
            found = sorted(set(found))
            hashes = np.array([h for h, _, _ in found], np.uint64)
            self.tables[key] = (hashes, np.array([k for _, k, _ in found]), np.array([p for _, _, p in found]))

    def matches(self, text: str) -> list[dict]:
        """The items found in a text: how many of their tokens, which share, how many slots differ."""
        doc = Canonical(text)
        met: dict[tuple[int, int, bool], set[int]] = {}
        alike: dict[int, set[int]] = {}  # by item: places that stand in the text with their own values
        exact = doc.exact if any(e for _, e in self.tables) else None
        for (width, own_values), (hashes, items, places) in self.tables.items():
            if own_values:
                own = windows(exact, width)
                left = np.searchsorted(hashes, own, "left")
                hit = np.nonzero(hashes[np.minimum(left, len(hashes) - 1)] == own)[0]
                for first in np.unique(left[hit]).tolist():
                    for row in range(first, np.searchsorted(hashes, hashes[first], "right")):
                        alike.setdefault(int(items[row]), set()).update(range(places[row], places[row] + width))
                continue
            for named in (False, True) if doc.named is not doc.plain else (False,):
                own = windows(doc.named if named else doc.plain, width)
                left = np.searchsorted(hashes, own, "left")
                hit = np.nonzero(hashes[np.minimum(left, len(hashes) - 1)] == own)[0]
                for at in hit.tolist():
                    for row in range(left[at], np.searchsorted(hashes, own[at], "right")):
                        # By item and alignment: the item's places that stand in the text.
                        met.setdefault((int(items[row]), at - int(places[row]), named), set()).update(range(places[row], places[row] + width))
        covered: dict[int, set[int]] = {}
        differ: dict[int, int] = {}
        for (k, shift, named), places in met.items():
            for run in _runs(sorted(places)):
                changed = self._slots(k, doc, shift, run, named)
                if changed is None:  # what has no slots in it is the item's own wording all the same
                    kinds = self.items[k][1].named_kind if named else self.items[k][1].kind
                    run = [p for part in _runs([p for p in run if not kinds[p]]) if len(part) >= WINDOW for p in part]
                    changed = 0
                if run:
                    covered.setdefault(k, set()).update(run)
                    differ[k] = min(changed, differ.get(k, changed))
        for k, places in alike.items():
            covered.setdefault(k, set()).update(places)
            differ.setdefault(k, 0)
        out = []
        for k, places in sorted(covered.items()):
            size = len(self.items[k][1])
            if len(places) >= min(size, max(WINDOW, min(ENOUGH, -(-size // 2)))):
                out.append({"item_id": self.items[k][0], "tokens": len(places), "share": round(len(places) / size, 6), "changed": differ[k]})
        return out

    def _slots(self, k: int, doc: Canonical, shift: int, run: list[int], named: bool) -> int | None:
        """How many slot values differ, or None where one value of the item stands for two of the text, or two for one."""
        item = self.items[k][1]
        kinds = item.named_kind if named else item.kind
        there: dict[tuple[int, str], str] = {}
        back: dict[tuple[int, str], str] = {}
        for p in run:
            if kinds[p]:
                kind, a, b = int(kinds[p]), item.surface(p), doc.surface(p + shift)
                if kind == 4:
                    a, b = a.lower(), b.lower()
                if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                    return None
        return sum(a != b for (_, a), b in there.items())


def _runs(places: list[int]) -> list[list[int]]:
    cuts = [0, *(i + 1 for i, (a, b) in enumerate(pairwise(places)) if b != a + 1), len(places)]
    return [places[a:b] for a, b in pairwise(cuts)]


_indexes: dict[str, Index] = {}

_FOUND = "array<struct<item_id:bigint,tokens:int,share:double,changed:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("tokens", pa.int32()), ("share", pa.float64()), ("changed", pa.int32())]))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """A column of the benchmark items found in the whole text.

    The benchmark is collected and handed to every worker, if its texts are within a fixed size; a larger one is to be given in parts.
    Each task joins its own documents' windows with the items' by hash, so no text and no window is shuffled, and a passage that a third of all
    documents share costs each of them only its own windows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size * 32 > MOST_BYTES:
        raise ValueError(f"the benchmark's texts have {size} bytes; give it in parts of {MOST_BYTES // 32}")
    rows = sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    tag = xxhash.xxh3_64_hexdigest(repr(rows).encode())
    shared = spark.sparkContext.broadcast(rows)

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if tag not in _indexes:
            _indexes[tag] = Index(shared.value)
        found: list[list[dict]] = []
        for _, _, values in text_slices(texts):
            found += [_indexes[tag].matches(t) for t in values]
        return pa.array(found, _ARROW)

    return find(F.coalesce(F.col(text), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, tokens (of the item found), share (of its tokens) and changed (slots with other values) for each
    document and each benchmark item that it holds.

    Texts become tokens: words in lower case, with typed placeholders for numbers, for units after a number and, in a second form, for names. Windows of
    eight tokens are joined by hash; windows on one alignment form runs, and a run counts only if its slots map one to
    one (else only its stretches of eight words or more without a slot). Windows of which less than half are words, and items under four tokens,
    are joined by their own values, without placeholders. An item is held if half of its tokens are covered, at least eight (all, if it has
    fewer) and at most 13; an item without a token is in no text.

    A null or empty text holds nothing. A null doc_id stays null; repeated rows give repeated results, repeated items one result each item_id and text.
    An empty documents or benchmark table gives an empty result. Other columns are not read."""
    return docs.select("doc_id", F.explode(leaks(docs, benchmark)).alias("_hit")).select("doc_id", "_hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    return docs.where(F.size(leaks(docs, benchmark)) == 0)
