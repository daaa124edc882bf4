"""Verdicts on urls from a list of host and path rules, kept as a sorted array of digests."""

from __future__ import annotations

import io
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class DigestFiles:
    """The list on disk: keys (sorted 64-bit digests), the rules' strings one after another with where each ends and
    how long its host is, and verdicts. Spark hands the files to each executor, whose workers share one memory map."""

    PARTS = ("keys", "ends", "hosts", "verdicts", "strings")

    def __init__(self, tag: str):
        self.tag = tag

    def open(self) -> dict[str, np.ndarray]:
        return {p: np.load(SparkFiles.get(f"{self.tag}-{p}.npy"), mmap_mode="r") for p in self.PARTS}


def hand_out(spark, rules: Iterable[Rule]) -> tuple[DigestFiles, list[str], list[int]]:
    """Writes the list sorted by digest to the shared folder and has Spark give it to the executors. A rule listed twice
    counts once, the first time."""
    first: dict[tuple[str, str], str] = {}
    for r in rules:
        first.setdefault((r.host, r.path), r.verdict)
    verdicts = sorted(set(first.values()))
    rows = sorted((digest(h + p), h + p, len(h), verdicts.index(v)) for (h, p), v in first.items())
    raw = [s.encode() for _, s, _, _ in rows]
    arrays = {
        "keys": np.array([r[0] for r in rows], np.uint64), "ends": np.cumsum([0, *map(len, raw)]).astype(np.int64),
        "hosts": np.array([r[2] for r in rows], np.int32), "verdicts": np.array([r[3] for r in rows], np.int32),
        "strings": np.frombuffer(b"".join(raw) or b"\0", np.uint8),
    }
    tag = "rules-" + xxhash.xxh64_hexdigest(b"\0".join(a.tobytes() for a in arrays.values()))
    context = spark.sparkContext
    known = {f.rsplit("/", 1)[-1] for f in context.listFiles}
    folder = shared_dir(spark, tag)
    for part, array in arrays.items():
        if (name := f"{tag}-{part}.npy") not in known:
            content = io.BytesIO()
            np.save(content, array)
            path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
            out.write(content.getvalue())
            out.close()
            context.addFile(f"{folder}/{name}")
    return DigestFiles(tag), verdicts, sorted({len(p) for _, p in first})


_open: dict[str, dict[str, np.ndarray]] = {}


def probe(files: DigestFiles, lengths: list[int], hosts: list[str], paths: list[str]) -> list[tuple[str | None, int]]:
    """The rule that fits each host and path, the longest first, and its verdict's number (-1: none).

    Every suffix of the host that begins at a label, with every prefix of the path as long as some rule's, is a candidate;
    all candidates of the batch are looked up in one binary search, and a hit counts only if the stored string is the same."""
    if files.tag not in _open:
        _open[files.tag] = files.open()
    own = _open[files.tag]
    keys, ends, strings = own["keys"], own["ends"], own["strings"]
    texts: list[str] = []
    host_length: list[int] = []
    starts = [0]
    for host, path in zip(hosts, paths):
        found = []
        at = 0
        while True:
            suffix = host[at:]
            found += [(len(suffix) + n, len(suffix), suffix + path[:n]) for n in lengths if n <= len(path)]
            at = host.find(".", at) + 1
            if not at:
                break
        found.sort(key=lambda x: (-x[0], -x[1]))
        texts += [x[2] for x in found]
        host_length += [x[1] for x in found]
        starts.append(len(texts))
    digests = np.fromiter(map(digest, texts), np.uint64, len(texts))
    left, right = np.searchsorted(keys, digests, "left"), np.searchsorted(keys, digests, "right")
    hit = np.full(len(texts), -1, np.int64)
    for i in np.nonzero(right > left)[0].tolist():
        raw = texts[i].encode()
        for k in range(left[i], right[i]):
            if own["hosts"][k] == host_length[i] and strings[ends[k]:ends[k + 1]].tobytes() == raw:
                hit[i] = k
                break
    out: list[tuple[str | None, int]] = []
    for a, b in zip(starts, starts[1:]):
        some = np.nonzero(hit[a:b] >= 0)[0]
        out.append((texts[a + some[0]], int(own["verdicts"][hit[a + some[0]]])) if len(some) else (None, -1))
    return out


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule and verdict of every url.

    A rule fits its host and the host's subdomains where the path starts with the rule's; the longest rule (host and path
    together, then host) wins. A url that no listed string fits gets `default`. No row is shuffled. The list is
    the caller's configuration; its files go to each executor once.

    A null url, or one without `://`, has an empty host and path. A rule with an empty path fits every path.
    Null keys stay null, repeated rows are judged alike, other columns are not read, an empty table gives an empty result,
    and an empty list gives every url the default."""
    files, verdicts, lengths = hand_out(pages.sparkSession, rules)

    @F.arrow_udf("rule string, number int")
    def fit(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = probe(files, lengths, hosts.to_pylist(), paths.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.int32())], ["rule", "number"])

    verdict = F.get(F.array([F.lit(v) for v in verdicts]), F.col("_fit.number")) if verdicts else F.lit(None).cast("string")
    return (
        pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("_fit", fit("host", "path"))
        .select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.when(F.col("_fit.number") >= 0, verdict).otherwise(default).alias("verdict"))
    )
