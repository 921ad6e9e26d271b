"""URL filters over a sorted digest array.

The rules' keys (host and path, like `example.com/en/7`) are hashed with 64-bit xxhash and sorted; the digests and the
full keys are written to one file, which Spark ships to the executors and tasks memory-map. A url is probed with every
suffix of its host at a dot and every prefix of its path that has the length of some rule's path: one vectorised binary
search over all probes of a batch, then a comparison with the stored key, so that a collision can't decide.

Defined results. A null url, and one without `://`, has empty host and path. The longest fitting rule wins, of equally
long ones that with the longer host. Repeated rows are judged alike. Without a fitting rule the default verdict holds.
Of rules with one key the first in (verdict) order counts. Urls of any length are judged whole, an empty table gives an
empty one. Extra columns are kept; those named host, path, rule or verdict are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import put_shared

SEED = 0
VERDICT = "struct<rule:string,verdict:string>"
#: One file holds so many rules; more are dealt into files of that size, each probed in turn.
RULES_PER_FILE = 4_000_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, SEED)


def index_bytes(rules: list[tuple[str, str]]) -> bytes:
    """The file's bytes: the number of rules, sorted digests, key offsets, verdicts (1: block), distinct path lengths, keys."""
    keys: dict[bytes, int] = {}
    for key, verdict in sorted(rules, key=lambda x: x[1]):
        keys.setdefault(key.encode(), int(verdict == "block"))
    order = sorted(keys, key=digest)
    lengths = sorted({len(k) - k.find(b"/") if b"/" in k else 0 for k in order})
    ends = np.cumsum([0, *(len(k) for k in order)]).astype(np.uint64)
    numbers = [[len(order), len(lengths)], [digest(k) for k in order], ends, [keys[k] for k in order], lengths]
    return b"".join([*(np.array(x, np.uint64).tobytes() for x in numbers), *order])


class Index:
    """A memory-mapped rule file."""

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in self.data[:16].view(np.uint64))
        at = 16
        parts = []
        for size in (n, n + 1, n, m):
            parts.append(self.data[at : at + 8 * size].view(np.uint64))
            at += 8 * size
        (self.digests, self.ends, self.blocks, lengths), self.keys = parts, self.data[at:]
        self.lengths = [int(x) for x in lengths]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter((digest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted):
            p = int(at[i])
            while p < len(self.digests) and self.digests[p] == wanted[i]:  # equal digests lie side by side
                if self.keys[int(self.ends[p]) : int(self.ends[p + 1])].tobytes() == keys[i]:
                    out[i] = p
                    break
                p += 1
        return out


def probes(host: bytes, path: bytes, lengths: list[int]) -> list[tuple[int, int, bytes]]:
    """Every key that could fit a url, with its length and its host's length."""
    out, labels = [], host.split(b".") if host else []
    for i in range(len(labels)):
        end = b".".join(labels[i:])
        out += [(len(end) + n, len(end), end + path[:n]) for n in lengths if n <= len(path)]
    return out


def _judge(files: list[str], default: str):
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        indexes = [Index(SparkFiles.get(f)) for f in files]
        for hosts, paths in batches:
            urls = [(h.encode(), p.encode()) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            best: list[tuple] = [()] * len(urls)
            for index in indexes:
                asked = [(i, *probe) for i, (h, p) in enumerate(urls) for probe in probes(h, p, index.lengths)]
                for (i, size, host, key), at in zip(asked, index.find([x[3] for x in asked])):
                    if at >= 0 and (size, host) > best[i][:2]:
                        best[i] = (size, host, key.decode(), "block" if index.blocks[at] else "allow")
            yield pa.StructArray.from_arrays([pa.array([b[2] if b else None for b in best], pa.string()), pa.array([b[3] if b else default for b in best], pa.string())], ["rule", "verdict"])

    return F.arrow_udf(judge, VERDICT)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", rules_per_file: int = RULES_PER_FILE) -> DataFrame:
    """pages with host, path, rule and verdict; rules has columns rule (host and path) and verdict (allow or block).

    Rules are read in files of bounded size, so that the driver never holds more than one file's rules.
    """
    spark = pages.sparkSession
    kept = rules.select("rule", "verdict").where("rule is not null and verdict in ('allow', 'block')")
    groups = max(1, -(-kept.count() // rules_per_file))
    files = []
    for g in range(groups):
        rows = kept.where(F.pmod(F.xxhash64("rule"), F.lit(groups)) == g).collect()
        data = index_bytes([(r["rule"], r["verdict"]) for r in rows])
        files.append(f"url-rules-{xxhash.xxh3_128_hexdigest(data)}.bin")
        spark.sparkContext.addFile(put_shared(spark, files[-1], data))
    judged = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    judged = judged.withColumn("__judged", _judge(files, default)("host", "path"))
    return judged.withColumn("rule", F.col("__judged.rule")).withColumn("verdict", F.col("__judged.verdict")).drop("__judged")
