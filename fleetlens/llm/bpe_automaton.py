"""Byte-pair encoding by a deterministic automaton over tokens.

`compile_merges` builds the automaton by one gadget per merge. It begins with a single state with a
loop for every byte. For the merge (u, v) -> w it finds the state that u leads to; if v leaves it, it
makes a copy of that state without v, lets u lead to the copy, and lets w go, from wherever u goes, to
where v led. Every token leads to one state, and a state is told by what it refuses. The automaton accepts,
for each byte string, the one sequence of tokens that the merges produce, so encoding is walking: a
prefix of a word has one last token, and a token may follow if the state of the last one accepts it.

What a state refuses is kept as ranges: tokens are numbered along the tree of left parts, children with the
later born first, so a token and those built on it after some merge are one run of numbers."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.frames import handed_out, slices, text_slices

#: Pieces of text whose ids a worker keeps, and their bytes.
KEPT_PIECES, KEPT_BYTES = 200_000, 12 << 20
#: Words up to this length are encoded side by side, longer ones one by one.
SIDE_BY_SIDE = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others get the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled tables: `state` of each token, `place` of each token along the tree, refused ranges
    per state, and a trie over the tokens' bytes as one hash table."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], singles: dict[int, int]):
        self.labels = labels
        self._compile(labels, merges, singles)
        self._trie(labels)

    def _compile(self, labels, merges, singles) -> None:
        size = max(labels) + 1
        state = [0] * size
        born = [-1] * size
        left: dict[int, int] = {}
        above, without, since = [-1], [-1], [-1]

        own = set(singles.values())

        def accepts(q: int, t: int) -> bool:
            while q:
                if born[t] >= since[q]:
                    t = left[t]
                elif without[q] == t:
                    return False
                else:
                    q = above[q]
            return True

        for k, (u, v, w) in enumerate(merges):
            if w in left or w in own:
                raise ValueError("each merge has to make a token of its own")
            # A pair that earlier merges never leave side by side makes no token, nor does what is built on it.
            if any(t not in left and t not in own for t in (u, v)) or not accepts(state[u], v):
                continue
            after = state[v]
            above.append(state[u])
            without.append(v)
            since.append(k)
            state[u] = len(above) - 1
            state[w], born[w], left[w] = after, k, u

        # Places along the tree of left parts, the later born child first.
        children: dict[int, list[int]] = {}
        births: dict[int, list[int]] = {}
        for w, u in left.items():  # in order of birth
            children.setdefault(u, []).append(w)
            births.setdefault(u, []).append(int(born[w]))
        place, end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        stack = [(t, False) for t in sorted(singles.values(), reverse=True)]
        while stack:
            t, done = stack.pop()
            if done:
                end[t] = at
                continue
            place[t] = at
            at += 1
            stack.append((t, True))
            stack += [(c, False) for c in children.get(t, ())]  # popped from the end: the last born first

        self.made = [*own, *left]
        used = sorted({int(state[t]) for t in left} | {int(state[t]) for t in singles.values()})
        number = {q: i for i, q in enumerate(used)}
        keys, ends = [], []
        for q in used:
            chain = q
            while chain > 0:
                t, k = without[chain], since[chain]
                # Those built on t before merge k are refused by others or not at all.
                older = bisect_left(births.get(t, ()), k) - 1
                keys.append(number[q] * size + int(place[t]))
                ends.append(int(place[children[t][older]]) if older >= 0 else int(end[t]))
                chain = above[chain]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.size, self.place = size, place
        self.state = np.array([number.get(int(s), 0) for s in state], np.int64)
        self.refused_from = np.concatenate(([-1], np.array(keys, np.int64)[order]))
        self.refused_to = np.concatenate(([-1], (np.array(keys, np.int64) // size * size + np.array(ends, np.int64))[order]))
        self.n_states = len(used)

    def accepts(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state after each `last` (-1: the start) has an arc for `token`."""
        arc = self.state[last] * self.size + self.place[token]
        i = np.searchsorted(self.refused_from, arc, "right") - 1
        return (last < 0) | (arc >= self.refused_to[i])

    def _trie(self, labels) -> None:
        tokens = self.made
        nodes: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for t in tokens:
            node = 0
            for byte in labels[t]:
                node_key = (node, byte)
                if node_key not in nodes:
                    nodes[node_key] = len(token_at)
                    token_at.append(-1)
                node = nodes[node_key]
            token_at[node] = t
        self.arcs = nodes
        self.token_at = np.array(token_at, np.int64)
        self.longest = max(len(labels[t]) for t in tokens)
        # One open table: slot of (node, byte), the next slots where it is taken.
        bits = max(8, int(len(nodes) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array([n * 256 + b + 1 for n, b in nodes], np.int64)
        slot = self._slot(keys)
        self.slots, self.next = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int64)
        left, self.probes = np.arange(len(keys)), 0
        targets = np.array(list(nodes.values()), np.int64)
        while len(left):
            self.probes += 1
            free = self.slots[slot[left]] == 0
            first = np.unique(slot[left][free], return_index=True)[1]
            won = left[free][first]
            self.slots[slot[won]], self.next[slot[won]] = keys[won], targets[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

        # The first two bytes have tables of their own.
        self.first = np.array([nodes.get((0, b), -1) for b in range(256)], np.int64)
        self.pair = np.zeros(len(token_at), np.int64)
        self.pair[self.first] = 256 * np.arange(256)
        self.second = np.full(65_536, -1, np.int64)
        for (node, byte), target in nodes.items():
            if token_at[node] >= 0 and node and self.first[self.pair[node] >> 8] == node:
                self.second[self.pair[node] + byte] = target

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there is none."""
        keys = node * 256 + byte + 1
        slot = self._slot(keys)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.slots[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[(held != 0) & ~hit]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = self._walk(w).tobytes()
            elif w:
                by_length.setdefault(-(-len(w) // 4) * 4, []).append(i)
        for width, rows in by_length.items():
            for a in range(0, len(rows), 16_384):
                part = rows[a:a + 16_384]
                for i, ids in zip(part, self._side_by_side([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        length = np.array([len(w) for w in words], np.int32)
        # One row per position, so that a step reads neighbours.
        text = np.ascontiguousarray(np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).T).astype(np.int64)
        last = np.full((width + 1, n), -1, np.int64)
        for i in range(int(length.max())):
            rows = np.nonzero(length > i)[0]
            node, before = np.zeros(len(rows), np.int64), last[i][rows]
            for j in range(i, width):
                if j == i:
                    node = self.first[text[j][rows]]
                else:
                    longer = length[rows] > j
                    if not longer.all():
                        rows, before, node = rows[longer], before[longer], node[longer]
                    node = self.second[self.pair[node] + text[j][rows]] if j == i + 1 else self.step(node, text[j][rows])
                    alive = node >= 0
                    rows, before, node = rows[alive], before[alive], node[alive]
                if not len(rows):
                    break
                token = self.token_at[node]
                some = np.nonzero(token >= 0)[0]
                if len(some) < len(token):
                    token = token[some]
                    fits = self.accepts(before[some], token)
                    last[j + 1][rows[some[fits]]] = token[fits]
                else:
                    fits = self.accepts(before, token)
                    last[j + 1][rows[fits]] = token[fits]
        # Back from the end of each word along its last tokens.
        lengths = self._lengths()
        ids = np.empty((n, width), np.int32)
        at = length.astype(np.int64)
        count = np.zeros(n, np.int64)
        rows = np.arange(n)
        while rows.size:
            token = last[at[rows], rows]
            count[rows] += 1
            ids[rows, width - count[rows]] = token
            at[rows] -= lengths[token]
            rows = rows[at[rows] > 0]
        flat = ids[np.arange(width) >= (width - count)[:, None]].tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _lengths(self) -> np.ndarray:
        if not hasattr(self, "_length"):
            self._length = np.zeros(self.size, np.int64)
            for t, b in self.labels.items():
                self._length[t] = len(b)
        return self._length

    def _walk(self, word: bytes) -> np.ndarray:
        """One long word: the arcs from each position, all of its tokens tried at once."""
        last = np.full(len(word) + 1, -1, np.int64)
        arcs, token_at = self.arcs, self.token_at
        for i in range(len(word)):
            node, tokens = 0, []
            for byte in word[i:i + self.longest]:
                node = arcs.get((node, byte), -1)
                if node < 0:
                    break
                tokens.append(token_at[node])
            found = np.array(tokens)
            some = np.nonzero(found >= 0)[0]
            before = np.full(len(some), last[i] if i else -1)
            fits = some[self.accepts(before, found[some])]
            last[i + 1 + fits] = found[fits]
        ids, at, lengths = [], len(word), self._lengths()
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return np.array(ids[::-1], np.int32)


class Codec:
    """Texts to ids and back for a byte-level vocabulary file."""

    def __init__(self, content: bytes):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(content)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without prefix space or normalizer is needed")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        singles = {letters[t]: i for t, i in vocab.items() if len(t) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not handled")
        labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.added}
        self.automaton = Automaton(labels, merges, singles)
        self.labels = labels | {i: t.encode() for t, i in self.added.items()}
        self.letters = letters
        self.split_words = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.kept = 0

    #: A space after something that isn't white space to any library begins a word, and what stands before ends there.
    UNSAFE = re.compile("[\\s᠎​﻿] ")
    ENDS_OPEN = re.compile("[\\s\u180e\u200b\ufeff]$")
    SAFE = re.compile("(?<=[^\\s᠎​﻿]) ")

    def pieces(self, text: str) -> list[str]:
        """The text cut before such spaces; every piece but the first lost its leading space."""
        return self.SAFE.split(text) if text[:1] == " " or self.UNSAFE.search(text) else text.split(" ")

    #: The vocabulary's own pattern, as it reads on ASCII text.
    ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

    def _words(self, pieces: list[str]) -> list[list[bytes]]:
        """The pre-split words of each piece: by the pattern where the piece is ASCII, else by
        the library, many pieces in one call, as each begins a word where the one before has ended."""
        found = self.ASCII_WORDS.findall
        rows = [[w.encode() for w in found(p)] if p.isascii() else [] for p in pieces]
        letters = self.letters
        open_ = [i for i, p in enumerate(pieces) if not p.isascii()]
        alone = [i for i in open_ if pieces[i][:1] != " " or self.ENDS_OPEN.search(pieces[i])]
        for i in alone:
            rows[i] = [bytes(map(letters.__getitem__, w)) for w, _ in self.split_words(pieces[i])]
        together = sorted(set(open_) - set(alone))
        ends = np.cumsum([len(pieces[i]) for i in together]).tolist()
        k = 0
        for w, (_, end) in self.split_words("".join(pieces[i] for i in together)):
            rows[together[k]].append(bytes(map(letters.__getitem__, w)))
            k += end == ends[k]
        return rows

    def _learn(self, firsts: set[str], others: set[str]) -> None:
        for led, pieces in enumerate((firsts, others)):
            new = [p for p in pieces if p not in self.known[led]]
            for a, b in slices([len(p) + 16 for p in new], 4 << 20):
                rows = self._words([" " + p for p in new[a:b]] if led else new[a:b])
                words = list(set().union(*rows))
                ids = dict(zip(words, self.automaton.encode_words(words)))
                self.known[led].update(zip(new[a:b], [b"".join([ids[w] for w in row]) for row in rows]))
                self.kept += sum(map(len, new[a:b]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        rows = [self.added_pattern.split(t) if self.added_pattern and "<" in t else [t] for t in texts]
        cut = [[self.added[s] if i % 2 else self.pieces(s) for i, s in enumerate(row)] for row in rows]
        if sum(map(len, self.known)) > KEPT_PIECES or self.kept > KEPT_BYTES:
            self.forget()
        firsts = {s[0] for row in cut for s in row if isinstance(s, list)}
        others: set[str] = set()
        for row in cut:
            for s in row:
                if isinstance(s, list):
                    others.update(s[1:])
        self._learn(firsts, others)
        first, other = self.known
        out = []
        for row in cut:
            got: list[bytes] = []
            for s in row:
                if isinstance(s, int):
                    got.append(s.to_bytes(4, "little"))
                else:
                    got.append(first[s[0]])
                    got.extend(map(other.__getitem__, s[1:]))
            out.append(b"".join(got))
        return out

    def forget(self) -> None:
        self.known[0].clear()
        self.known[1].clear()
        self.kept = 0

    def decode(self, ids: bytes) -> str:
        """The arc labels one after another; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(key: str, content: Broadcast) -> Codec:
    """The worker's codec, compiled once per process."""
    if key not in _codecs:
        _codecs[key] = Codec(content.value)
    return _codecs[key]


def _per_text(kind: str, work: Callable, docs: DataFrame, vocabulary: str):
    key, content = handed_out(docs.sparkSession, vocabulary)

    @F.arrow_udf(kind)
    def mapped(column: pa.Array) -> pa.Array:
        own, found = codec(key, content), []
        sizes = pc.binary_length(column).to_pylist() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else [4 * len(x) for x in column]
        for a, b in slices(sizes):
            found += work(own, column[a:b])
        return pa.array(found, _ARROW[kind])

    return mapped


_ARROW = {
    "array<int>": pa.list_(pa.int32()),
    "string": pa.string(),
    "n_tokens long, ids_sha256 string, decoded_sha256 string": pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
}


def encode_column(docs: DataFrame, vocabulary: str, text: str = "text"):
    """A column of the ids (array of int) of the whole text; a null or empty text has none."""
    work = lambda own, part: [np.frombuffer(x, "<i4") for x in own.encode(part.to_pylist())]
    return _per_text("array<int>", work, docs, vocabulary)(F.coalesce(F.col(text), F.lit("")))


def decode_column(docs: DataFrame, vocabulary: str, ids: str = "ids"):
    """A column of the text that an array of ids spells; a null array spells the empty text."""
    work = lambda own, part: [own.decode(np.array(x, "<u4").tobytes()) for x in part.to_pylist()]
    return _per_text("string", work, docs, vocabulary)(F.coalesce(F.col(ids), F.array().cast("array<int>")))


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded_sha256 (of what the ids spell) of every whole text; nulls, long texts
    and repeated rows as in `round_trip`. Rows go back a slice at a time, so that a batch's ids are never all in memory."""
    name, content = handed_out(docs.sparkSession, vocabulary)

    def work(batches):
        for batch in batches:
            own = codec(name, content)
            for a, b, texts in text_slices(batch.column(1)):
                raw = own.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                digests = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends), pa.int64()), ids, pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])
        # A worker lives on for other stages; what it keeps is for this one.
        codec(name, content).forget()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one pass.

    Texts never leave their task. They are cut at spaces that always begin a word, each distinct piece
    of a slice is walked through the automaton once, and pieces are kept up to a fixed bound. Special
    strings inside a text become their own ids, as the tokenizers library does by default.

    A null or empty text gives no ids (digests of nothing). A long text, or a word of any length, is
    encoded whole. A null key stays null; repeated rows give repeated results; other columns are not read.
    An empty table gives an empty result."""
    def work(own: Codec, part: pa.Array) -> list[dict]:
        rows = []
        for ids in own.encode(part.to_pylist()):
            rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(own.decode(ids).encode()).hexdigest()})
        return rows

    both = _per_text("n_tokens long, ids_sha256 string, decoded_sha256 string", work, docs, vocabulary)
    return docs.select(F.col(key).alias("doc_id"), both(F.coalesce(F.col(text), F.lit(""))).alias("_it")).select("doc_id", "_it.*")
