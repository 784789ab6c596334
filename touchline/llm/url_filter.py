"""URL filter over a sorted digest array.

Rules become one file: 64-bit xxhash keys in ascending order, the rules' strings and verdicts beside them. The file is
written to the cluster's shared folder and handed to executors with ``addFile``; a task maps it into memory, probes a
whole batch of candidate keys with one vectorised binary search, and compares the stored string of every hit, so a
collision of digests never decides.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with its path. Candidates of a url are
its host's suffixes times the rule path lengths that occur, which the file lists. The longest fitting rule wins (by the
length of host and path together; then the longer host).

Scale: a scan and a narrow map, no shuffle, so no host can be hot. Executors share the mapped pages; the file is as long
as the rules and is not loaded into the heap.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import ascii_lower, table

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


class DigestArray:
    """The mapped file. Layout, all little-endian: counts, path lengths, keys, string ends, verdicts, strings."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        n, depths, longest = self.raw[:24].view(np.int64)
        self.longest = int(longest)
        at = 24
        parts = []
        for count, kind in ((depths, np.int64), (n, np.uint64), (n, np.int64), (n, np.uint8)):
            end = at + int(count) * np.dtype(kind).itemsize
            parts.append(self.raw[at:end].view(kind))
            at = end
        self.depths, self.keys, self.ends, self.verdicts = parts
        self.depths = self.depths.tolist()
        self.strings = self.raw[at:]

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """Of two rules with the same host and path the blocking one holds."""
        held: dict[str, int] = {}
        for verdict, host, path in rules:
            rule = host + path
            held[rule] = max(held.get(rule, 0), _VERDICTS.index(verdict))
        order = sorted((xxhash.xxh64_intdigest(r.encode()), r) for r in held)
        encoded = [r.encode() for _, r in order]
        depths = sorted({len(r) - r.index("/") if "/" in r else 0 for r in held})
        head = np.array([len(order), len(depths), max(map(len, held), default=0)], np.int64)
        ends = np.cumsum([len(e) for e in encoded], dtype=np.int64) if encoded else np.zeros(0, np.int64)
        body = (np.array(depths, np.int64), np.array([k for k, _ in order], np.uint64), ends, np.array([held[r] for _, r in order], np.uint8))
        return head.tobytes() + b"".join(a.tobytes() for a in body) + b"".join(encoded)

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of the rule each candidate equals, or -1."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        first = np.searchsorted(self.keys, digests)
        found = np.full(len(candidates), -1, np.int64)
        hit = np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, max(0, len(self.keys) - 1))] == digests)) if len(self.keys) else []
        for i in hit:
            k = int(first[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # strings may share a digest
                if self.string(k) == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def string(self, k: int) -> bytes:
        return self.strings[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict for each url, None without a rule."""
        candidates: list[bytes] = []
        owner: list[tuple[int, int, int]] = []  # url, length of the rule, length of its host
        for u, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            at = len(host)
            while at >= 0:
                # Suffixes from the top domain down: net, example.net, ...
                at = host.rfind(".", 0, at)
                suffix = host[at + 1 :]
                if len(suffix) > self.longest:
                    break
                for d in self.depths:
                    if d <= len(path):
                        candidates.append((suffix + path[:d]).encode())
                        owner.append((u, len(suffix) + d, len(suffix)))
        best: dict[int, tuple[int, int, int]] = {}
        found = self.probe(candidates)
        for i in np.flatnonzero(found >= 0):
            u, size, host_size = owner[i]
            best[u] = max(best.get(u, (0, 0, 0)), (size, host_size, int(found[i])))
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for u, (_, _, k) in best.items():
            rules[u], verdicts[u] = self.string(k).decode(), _VERDICTS[self.verdicts[k]]
        return rules, verdicts


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes the file to the shared folder, hands it to executors and returns its name there."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(DigestArray.write(rules)))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString() if path.toUri().getScheme() else "file://" + path.toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], *, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``keep`` columns (default: all) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host, path). A url without a rule, without a host, or null gets ``default``: the array lists
    what is known, all else passes. Existing columns of the four names are replaced.
    """
    made = ("host", "path", "rule", "verdict")
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    name = publish(pages.sparkSession, rules)
    parsed = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).schema

    def run(batches):
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found, verdicts = array.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array([v or default for v in verdicts], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return parsed.mapInArrow(run, schema)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES, keep=["page_id", "url"]).drop("url")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
   CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
