"""Near duplicates: an exact join of word n-gram sets by Jaccard similarity, and the groups that the links form.

Sets are ordered by a hash of their n-grams, the same order for all. Candidates come from signatures that two
similar sets must share: hashes are cut into more ranges than two such sets can differ in, so some ranges are equal in both. The candidates
of a set are then checked as a prefix tree: sets in order share the overlap of their common beginnings, and a branch is left
as soon as what remains of either side can't reach the overlap that a link needs."""

from __future__ import annotations

from contextlib import contextmanager
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window

from fleetlens.llm.frames import BATCH_BYTES, BATCH_KEY, cut, text_slices

#: Words of an n-gram, and the similarity of a link in hundredths, of op8; other callers may pass their own.
WORDS, SIMILAR = 4, 85
#: Two sets may differ in so few n-grams that pairs of ranges are signatures.
PAIRED = 4
#: A side of a join is broadcast up to so many bytes; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Nodes of one bucket are compared by blocks of so many; a node's sketch has so many counts.
BLOCK, BINS = 256, 256

#: Signatures are dealt out by so many parts a shuffle partition; of the rest of one, so many bytes are kept: a wrong candidate is found
#: out when its sets are compared.
PARTS, REST = 4, 5
PAIR = np.dtype([("rest", "u1", (REST,)), ("node", "<i8")])

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@contextmanager
def _small_batches(spark):
    """What runs inside gets batches of BATCH_BYTES; the session has its own setting again afterwards."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The text's set, as sorted 64-bit hashes: words are runs of anything but ASCII white space, A-Z lower-cased."""
    found = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    width = min(words, len(w))
    total = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - width + 1 + i])
    return np.unique(total)


def set_digest(tokens: np.ndarray) -> int:
    """A set's own number (signed 64 bits)."""
    return int(mixed(np.array([mixed(tokens ^ _M2).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def needed(a: int, b: int, similar: int = SIMILAR) -> int:
    """The least overlap with which sets of these sizes link."""
    return -(-similar * (a + b) // (100 + similar))


@cache
def classes(similar: int = SIMILAR) -> tuple[np.ndarray, list[int]]:
    """Size classes: the first size of each, and how many n-grams can be in only one of two linked
    sets of which the smaller is of the class. The larger is of the class or the next."""
    firsts = [1, 2]
    while firsts[-1] < 1 << 31:
        firsts.append(max(firsts[-1] + 1, (firsts[-1] - 1) * 100 // similar + 1))
    apart = []
    for after in firsts[1:]:
        small = after - 1
        large = small * 100 // similar
        apart.append((small + large) * (100 - similar) // (100 + similar))
    return np.array(firsts[:-1]), apart


def signatures(tokens: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Signatures of which any two linked, different sets share one.

    With a smaller set of class k, two linked sets differ in d = classes()[1][k] n-grams at most. Hashes are cut into m > d ranges, at
    least m - d of which hold the same in both. Ordered by how much they hold, the first d + 1 ranges of
    either set then have one in common; where d is small, there are d + 2 ranges, and every two of them are a signature."""
    if not len(tokens):
        return np.empty(0, np.int64)
    firsts, apart = classes(similar)
    k = int(np.searchsorted(firsts, len(tokens), "right")) - 1
    content = mixed(tokens ^ _M1)
    out = []
    for c in (k - 1, k):
        if c < 0 or not (d := apart[c]):
            continue
        m = d + 2 if d <= PAIRED else d + 1 + -(-3 * d // 10)
        place = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(place, minlength=m)
        some = np.nonzero(held)[0]
        sums = np.zeros(m, np.uint64)
        sums[some] = np.add.reduceat(content, np.cumsum(held)[some] - held[some])
        own = mixed(sums + np.arange(m, dtype=np.uint64) * _M2 + np.uint64(c + 1))
        if d <= PAIRED:
            a, b = np.array(list(combinations(range(m), 2))).T
            out.append(mixed(own[a] * np.uint64(3) + own[b]))
        else:
            out.append(own[np.lexsort((np.arange(m), -held))[:d + 1]])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _scan(batches, words: int):
    """Per row the key, the set's size and its digest, and the sketch of a set that the task has not met before."""
    seen: set[int] = set()
    for batch in batches:
        for a, b, texts in text_slices(batch.column(1)):
            sets = [shingles(t, words) for t in texts]
            digests = [set_digest(tokens) if len(tokens) else None for tokens in sets]
            sketches = []
            for tokens, digest in zip(sets, digests):
                sketches.append(None if digest is None or digest in seen else sketch(tokens))
                seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array([len(tokens) for tokens in sets], pa.int64()), pa.array(digests, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "node", "sketch"])
    _words.clear()  # a worker lives on for other stages


def _packed(batches, words: int, similar: int, parts: int):
    """The signatures of the sets that the task has not met before, as blocks: the part of the signatures, and
    (rest of the signature, node) one after the other. A row each would be twice as large, and there are millions."""
    seen: set[int] = set()
    for batch in batches:
        for _, _, texts in text_slices(batch.column(0)):
            sigs, nodes = [], []
            for t in texts:
                tokens = shingles(t, words)
                digest = set_digest(tokens) if len(tokens) else None
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    sigs.append(signatures(tokens, similar))
                    nodes.append(np.full(len(sigs[-1]), digest))
            if not sigs:
                continue
            sig = np.concatenate(sigs).view(np.uint64)
            part, pairs = (sig % np.uint64(parts)).astype(np.int32), np.zeros(len(sig), PAIR)
            pairs["rest"] = (sig // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :REST]
            pairs["node"] = np.concatenate(nodes)
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            pairs = pairs[order]
            blocks = [pairs[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(pairs)])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])
    _words.clear()


def _buckets(batches):
    """Of all blocks of some parts: sig, node, hub and size of the signatures that more than one node has. The hub is the smallest node."""
    found = [(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for batch in batches]
    parts = np.concatenate([np.zeros(0, np.int64), *[np.repeat(np.array(p, np.int64), [len(x) // PAIR.itemsize for x in blocks]) for p, blocks in found]])
    if not len(parts):
        return
    pairs = np.frombuffer(b"".join(x for _, blocks in found for x in blocks), PAIR)
    rest = np.zeros((len(pairs), 8), np.uint8)
    rest[:, :REST] = pairs["rest"]
    sig, node = (parts << (8 * REST)) | rest.view("<u8").ravel().astype(np.int64), pairs["node"].astype(np.int64)
    del found, rest, parts, pairs
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[keep], node[keep]
    starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    sizes = np.diff(np.append(starts, len(sig)))
    size, hub = np.repeat(sizes, sizes), np.repeat(node[starts], sizes)
    several = np.flatnonzero(size > 1)
    for a in range(0, len(several), 1 << 16):
        at = several[a:a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(node[at]), pa.array(hub[at]), pa.array(size[at])], ["sig", "node", "hub", "size"])


def linked(hub: np.ndarray, sets: list[np.ndarray], similar: int = SIMILAR) -> list[bool]:
    """Which of the sets (sorted hashes) link to the hub's, by one walk through their prefix tree."""
    found = [False] * len(sets)
    before, overlap, depth = np.empty(0, np.uint64), np.zeros(1, np.int64), 0
    for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()):
        s = sets[i]
        if 100 * min(len(s), len(hub)) < similar * max(len(s), len(hub)):
            continue
        n = min(len(s), depth)
        other = np.nonzero(s[:n] != before[:n])[0]
        start = int(other[0]) if len(other) else n
        least, so_far = needed(len(s), len(hub), similar), int(overlap[start])
        left = len(hub) - int(np.searchsorted(hub, s[start - 1], "right")) if start else len(hub)
        if so_far + min(len(s) - start, left) < least:
            before, depth = s, start
            overlap = overlap[:start + 1]
            continue
        rest = s[start:]
        at = np.minimum(np.searchsorted(hub, rest), len(hub) - 1)
        overlap = np.concatenate((overlap[:start + 1], so_far + np.cumsum(hub[at] == rest)))
        before, depth = s, len(s)
        found[i] = int(overlap[-1]) >= least
    return found


def sketch(tokens: np.ndarray) -> bytes:
    """How many of a set's hashes are in each of 256 ranges, 255 at most. Two sets differ in as many n-grams
    as their counts do, or more."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _counts(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _may_link(batches, similar: int):
    """The rows (hub, node, common) whose sizes and sketches (n, hub_n, sketch, hub_sketch) allow a link."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("hub_n").to_numpy()
        least = np.abs(_counts(batch.column("sketch")) - _counts(batch.column("hub_sketch"))).sum(1)
        fits = pa.array((least <= (n + m) * (100 - similar) // (100 + similar)) & (100 * np.minimum(n, m) >= similar * np.maximum(n, m)))
        yield batch.select(["hub", "node", "common"]).filter(fits)


def _apart(batches, similar: int):
    """Of rows sorted by unit (signature and two blocks): the pairs of nodes of different components that
    sizes and sketches allow to link. A unit has two blocks of nodes at most."""
    def pairs(rows: pa.Table):
        unit = np.stack([rows[c].to_numpy() for c in ("sig", "low", "high")], 1)
        node, label, block, size = (rows[c].to_numpy() for c in ("node", "label", "block", "n"))
        counts = _counts(rows["sketch"])
        cuts = np.nonzero((unit[1:] != unit[:-1]).any(1))[0] + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            for i in range(a, b - 1):
                others = np.arange(i + 1, b)
                others = others[(label[others] != label[i]) & ((unit[i, 1] == unit[i, 2]) | (block[others] != block[i]))]
                if not len(others):
                    continue
                total = size[others] + size[i]
                least = np.abs(counts[others] - counts[i]).sum(1)
                near = others[least <= total * (100 - similar) // (100 + similar)]
                yield np.full(len(near), node[i]), node[near]

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not len(rows):
            continue
        # The last unit may go on in the next batch.
        keys = np.stack([rows[c].to_numpy() for c in ("sig", "low", "high")], 1)
        whole = int(np.nonzero((keys == keys[-1]).all(1))[0][0])
        held = rows.slice(whole)
        yield _pairs(list(pairs(rows.slice(0, whole)))) if whole else _pairs([])
    if held is not None and len(held):
        yield _pairs(list(pairs(held)))


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = ([x[i] for x in found] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["hub", "node"])


def _check(batches, similar: int):
    """Rows (hub, node, hub_set, set) to the pairs that link; rows of one hub in a batch are one tree."""
    for batch in batches:
        hubs, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hub_sets, sets = ([np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()] for i in (2, 3))
        out = np.zeros(len(hubs), bool)
        order = np.argsort(hubs, kind="stable")
        cuts = np.nonzero(np.diff(hubs[order]))[0] + 1
        for rows in np.split(order, cuts) if len(order) else []:
            out[rows] = linked(hub_sets[rows[0]], [sets[r] for r in rows], similar)
        yield pa.RecordBatch.from_arrays([pa.array(hubs[out]), pa.array(nodes[out])], ["hub", "node"])


def _small(rows: DataFrame, width: int) -> DataFrame:
    """Broadcast if the rows are counted to be within the bound, else left to a shuffled join."""
    return F.broadcast(rows) if rows.count() * width <= BROADCAST_BYTES else rows


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and set (bytes of sorted hashes) of the wanted (doc_id, node, times) rows, made again from their texts. Only sets of rows that
    come more than once are shuffled, so that one of them stays."""
    def make(batches):
        for batch in batches:
            nodes, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(2)):
                kept = [(n, k, tokens) for n, k, tokens in zip(nodes[a:b], times[a:b], (shingles(t, words) for t in texts)) if set_digest(tokens) == n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _, _ in kept], pa.int64()), pa.array([k for _, k, _ in kept], pa.int64()), pa.array([s.astype("<u8").tobytes() for _, _, s in kept], pa.binary())],
                    ["node", "times", "set"])
        _words.clear()

    texts = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null")
    joined = texts.join(_small(wanted, 64), F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "times", "text")
    made = cut(joined.mapInArrow(make, "node long, times long, set binary"), "join-sets")
    one = made.where("times = 1").select("node", "set")
    several = made.where("times > 1")
    return one if several.isEmpty() else one.unionByName(several.select("node", "set").dropDuplicates(["node"]))


def _sketches(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and sketch of the nodes, of the scanned rows."""
    return cut(rows.where("sketch is not null").join(_small(nodes, 32), "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]), "join-sketches")


def components(edges: DataFrame) -> DataFrame:
    """node and label of every node of the edges (a, b): the smallest node that it reaches. Each round takes the smallest label
    around and then the label's own label, so rounds grow with the logarithm of a chain's length; each is
    written to the shared folder."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("around"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "around").alias("to"), F.col("label").alias("old"))
        nearer = cut(nearer, "labels-near")
        jump = nearer.select(F.col("node").alias("_n"), F.col("to").alias("further"))
        after = cut(nearer.join(jump, nearer["to"] == jump["_n"], "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "old"), "labels")
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels


def _once(pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (hub, node), each once, whichever of it is the hub."""
    once = pairs.groupBy(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y")).agg(F.min("hub").alias("hub"))
    return cut(once.select("hub", F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("node")), f"{name}-pairs")


def _links(once: DataFrame, sets: DataFrame, name: str, similar: int) -> DataFrame:
    """The pairs of _once() that link, as (a, b). Sets that are in no pair are not sent, where the pairs are few enough to tell."""
    own, hubs = sets.select("node", F.col("set").alias("own")), sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set"))
    few = once.select("hub").distinct()
    if few.count() * 32 <= BROADCAST_BYTES:  # else a shuffle by hub for it would be one that Spark can't split at a large hub
        hubs = hubs.join(F.broadcast(few), "hub", "left_semi")
    checked = own.join(_small(once, 48), "node").join(hubs, "hub").select("hub", "node", "hub_set", "own").mapInArrow(lambda batches: _check(batches, similar), "hub long, node long")
    return cut(checked.select(F.col("hub").alias("a"), F.col("node").alias("b")), f"{name}-links")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component."""
    own, hubs = labels.withColumnRenamed("label", "_own"), labels.select(F.col("node").alias("hub"), F.col("label").alias("_hub"))
    apart = F.coalesce("_own", "node") != F.coalesce("_hub", "hub")
    return pairs.join(own, "node", "left").join(hubs, "hub", "left").where(apart).select("hub", "node")


def _wanted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, node and times of one row a node of the pairs: the smallest doc_id, and how many rows have both."""
    nodes = pairs.select("node").union(pairs.select("hub")).distinct()
    every = rows.select("node", "doc_id").join(_small(nodes, 32), "node", "left_semi").groupBy("node", "doc_id").agg(F.count("*").alias("times"))
    first = every.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "times")).alias("first"))
    return cut(first.select("node", "first.doc_id", "first.times"), "join-wanted")


def link_components(docs: DataFrame, rows: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame | None:
    """node and label of the nodes that have a link, of the scanned rows; None if there is none.

    A bucket is the nodes of one signature. Signatures go to it as packed blocks, and are written nowhere. First each bucket's hub, its
    node with most shared signatures, meets the other nodes on sizes and sketches, and what these allow is checked: each node with the hub it shares most buckets with, then with those hubs that this has not brought into its component. Then the buckets whose nodes
    are not all in one component are compared by blocks of nodes, on sizes and sketches alone; only pairs between different components
    that these allow are checked. No such pair is left out, and pairs that the components make needless are not looked at. Sets are made of the nodes of
    allowed pairs alone: nodes that only share signatures, whose number grows faster than the texts, send their sketches and no sets."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("text").mapInArrow(lambda batches: _packed(batches, words, similar, PARTS * parts), "part int, block binary")
    buckets = cut(blocks.repartition(2 * parts, "part").mapInArrow(_buckets, "sig long, node long, hub long, size long"), "buckets")
    if buckets.isEmpty():
        return None
    sketches = _sketches(rows, buckets.select("node").distinct())
    degrees = buckets.groupBy("node").agg(F.count("*").alias("degree"))
    best = buckets.join(degrees, "node").groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    pairs = buckets.select("sig", "node").join(best, "sig").where("node != hub").groupBy("hub", "node").agg(F.count("*").alias("common"))
    about = sketches.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    pairs = cut(pairs.join(sketches, "node").join(about, "hub").mapInArrow(lambda batches: _may_link(batches, similar), "hub long, node long, common long"), "hub-pairs")
    sets = _sets(docs, _wanted(rows, pairs), words)
    nearest = pairs.groupBy("node").agg(F.max_by("hub", F.struct("common", "hub")).alias("hub")).select("hub", "node")
    edges = _links(_once(nearest, "nearest"), sets, "nearest", similar)
    labels = None if edges.isEmpty() else components(edges)
    # What is in one component already need not be checked again, which is most of what near copies have in common.
    other = pairs.select("hub", "node") if labels is None else _between(pairs.select("hub", "node"), labels)
    further = _links(_once(other.join(nearest, ["hub", "node"], "left_anti"), "hub"), sets, "hub", similar)
    if not further.isEmpty():
        edges = cut(edges.unionByName(further), "links")
        labels = components(edges)

    # A hub has been checked against its whole bucket, so a bucket of two is done.
    known = buckets.where("size > 2").select("sig", "node", "size")
    known = known.withColumn("label", F.col("node")) if labels is None else known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = known.repartition(parts, "sig")
    several = known.groupBy("sig").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("sig")
    open_ = cut(known.join(several, "sig"), "buckets-open")
    if open_.isEmpty():
        return labels
    place = F.row_number().over(Window.partitionBy("sig").orderBy("label", "node")) - 1
    block = open_.withColumn("block", F.floor(place / BLOCK).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))))
    units = block.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label").join(sketches, "node")
    units = units.repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high", "block", "node").select("sig", "low", "high", "block", "node", "label", "n", "sketch")
    once = _once(units.mapInArrow(lambda batches: _apart(batches, similar), "hub long, node long"), "block")
    if once.isEmpty():
        return labels
    more = _links(once, _sets(docs, _wanted(rows, once), words), "block", similar)
    if more.isEmpty():
        return labels
    return components(cut(edges.unionByName(more), "links-all"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and node (the set's digest) of every row: the exact Jaccard join at `similar` hundredths on sets of
    n-grams of `words` words (0.85 and 4, unless told otherwise), one row a document with the smallest doc_id that links reach.

    Equal sets are one node from the start, so copies cost nothing further. Whole texts are read once for sizes and digests and once for signatures, and
    those of candidate nodes a third time. What is shuffled are signatures (about a third of the number of n-grams), and
    the sets of nodes that share one and whose sketches allow a link. N-grams and sets are told apart by 64-bit hashes.

    A text with fewer than `words` words is one n-gram; a null or empty text, or one of white space, has no set and is its own component. A null doc_id
    takes part, but names no component unless there is no other (then component_id is null). Repeated rows are copies. An empty table gives an
    empty result. Other columns are not read."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with _small_batches(docs.sparkSession):
        rows = cut(slim.mapInArrow(lambda batches: _scan(batches, words), "doc_id long, n long, node long, sketch binary"), "join-rows")
        labels = link_components(slim, rows, words, similar)
    own = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    if labels is None:
        named = own.where("copies > 1").select("node", F.col("least").alias("component"))
    else:
        grouped = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = grouped.groupBy("label").agg(F.min("least").alias("component"), F.sum("copies").alias("all")).where("all > 1")
        named = grouped.join(smallest, "label").select("node", "component")
    named = cut(named, "join-named")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"), "node")


def keep_one(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One document of each component of near_duplicates(), the one with the smallest doc_id, with its own columns. Of repeated rows (same
    doc_id, same set) any one stays; documents without words all stay, as does a null doc_id that is alone."""
    own = docs.columns
    groups = cut(near_duplicates(docs, words, similar), "join-groups")
    named = groups.where("node is not null").groupBy("doc_id", "node").agg(F.min("component_id").alias("component"), F.count("*").alias("times"))
    named = cut(named.select("doc_id", "node", F.col("doc_id").eqNullSafe(F.col("component")).alias("stays"), "times").where("not stays or times > 1"), "join-decided")

    @F.arrow_udf("long")
    def digest(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, values in text_slices(texts):
            sets = (shingles(t, words) for t in values)
            out += [set_digest(tokens) if len(tokens) else None for tokens in sets]
        return pa.array(out, pa.int64())

    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), digest(F.coalesce("text", F.lit(""))).alias("_node"))
    again = named.where("stays").select("doc_id", "node")
    same = lambda t: F.col("_id").eqNullSafe(t["doc_id"]) & (F.col("_node") == t["node"])
    kept = marked.join(_small(named.select("doc_id", "node"), 48), same(named), "left_anti").select("_doc.*")
    if again.isEmpty():
        return kept
    return kept.unionByName(marked.join(_small(again, 48), same(again), "left_semi").dropDuplicates(["_id", "_node"]).select("_doc.*"))
