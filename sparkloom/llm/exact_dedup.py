"""Exact deduplication by an extendible-hash index on shared files.

1. One pass hashes every text (A-Z lowered): a 64-bit key and the SHA-256.
2. The directory: starting from one bucket, a bucket with more than ``capacity`` distinct keys is split
   on its next key bit, and the directory doubles whenever a bucket's local depth would exceed the global
   depth. Only counts per key prefix reach the driver (2^``max_depth`` at most). So that this many slots do at any size, the capacity
   is at least twice the mean of a slot; a bucket is never held in memory: its owner reads it as a stream and chains what collides.
3. Owner tasks hold ranges of buckets. Each distinct text of an Arrow batch is sent to its owner once, with the
   number of its copies, so a text that makes up a third of all rows costs its owner one row a batch.
   Owners read rows sorted by key, chain texts of equal key and compare their bytes.
4. The chains are written to shared storage as the index: bucket, key, chain place, digest, row that stays, copies.
   Rows find their chain by a join on the digest, hot digests by a broadcast of bounded size.

Null text counts as empty; empty texts are equal to one another; of equal texts the largest doc_id stays (of rows
that repeat a doc_id too, ``kept`` is true for each row with it). Very long texts are hashed and compared whole. An empty table gives no
rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import TextView, Workspace, heavy_at, join_by_key, partitions_for, plain, tidy


def normalised(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column, "")) if len(column) else column


def digests(column: pa.Array) -> tuple[TextView, list[bytes]]:
    view = TextView(normalised(column))
    return view, [hashlib.sha256(view.raw(i)).digest() for i in range(len(view))]


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        view, sha = digests(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([key_of(x) for x in sha], pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "key", "sha"])


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of the batch once, with its largest doc_id and its number of rows."""
    for b in batches:
        view, sha = digests(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        seen: dict[bytes, list] = {}
        for i, x in enumerate(sha):
            if (s := seen.get(x)) is None:
                seen[x] = [ids[i], 1, i]
            else:
                s[0], s[1] = max((v for v in (s[0], ids[i]) if v is not None), default=None), s[1] + 1
        rows = list(seen.items())
        for at in range(0, len(rows), 500):
            part = rows[at : at + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key_of(x) for x, _ in part], pa.int64()), pa.array([s[0] for _, s in part], pa.int64()), pa.array([s[1] for _, s in part], pa.int64()), pa.array([view.raw(s[2]) for _, s in part], pa.binary())],
                names=["key", "top", "n", "text"],
            )


class Directory:
    """The extendible-hash directory: ``slots[p]`` is the bucket of the keys whose first ``depth`` bits are p."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """counts: distinct keys for each prefix of ``max_depth`` bits."""
        self.max_depth, self.depth = int(len(counts)).bit_length() - 1, 0
        self._sum = np.r_[0, np.cumsum(counts)]
        self.slots, self.buckets = np.zeros(1, np.int64), [(0, 0)]  # bucket: (prefix, local depth)
        todo = [0]
        while todo:
            b = todo.pop()
            prefix, local = self.buckets[b]
            if self._size(prefix, local) <= capacity or local == self.max_depth:
                continue
            if local == self.depth:  # the directory doubles
                self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
            self.buckets[b] = (prefix * 2, local + 1)
            self.buckets.append((prefix * 2 + 1, local + 1))
            span = 1 << (self.depth - local - 1)
            self.slots[(prefix * 2 + 1) * span : (prefix * 2 + 2) * span] = len(self.buckets) - 1
            todo += [b, len(self.buckets) - 1]

    def _size(self, prefix: int, local: int) -> int:
        span = 1 << (self.max_depth - local)
        return int(self._sum[(prefix + 1) * span] - self._sum[prefix * span])

    def size(self, bucket: int) -> int:
        return self._size(*self.buckets[bucket])

    def owners(self, n: int) -> np.ndarray:
        """For each slot the owner of its bucket: runs of neighbouring buckets with about equal numbers of keys."""
        order = sorted(range(len(self.buckets)), key=lambda b: self.buckets[b][0] << (self.max_depth - self.buckets[b][1]))
        before, total, owner = 0, max(1, int(self._sum[-1])), {}
        for b in order:
            owner[b] = min(n - 1, before * n // total)
            before += self.size(b)
        return np.array([owner[b] for b in self.slots])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; texts of one key are chained and compared byte by byte."""
    key, chain, out = None, [], []

    def flush():
        out.extend((key, place, hashlib.sha256(c[0]).digest(), c[1], c[2]) for place, c in enumerate(chain))

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "place", "sha", "keep_id", "group_size"])

    for b in batches:
        text = b.column("text")
        for i, (k, top, n) in enumerate(zip(b.column("key").to_pylist(), b.column("top").to_pylist(), b.column("n").to_pylist(), strict=True)):
            if k != key:
                flush()
                key, chain = k, []
            own = text[i].as_py()
            for c in chain:
                if c[0] == own:
                    c[1], c[2] = max((v for v in (c[1], top) if v is not None), default=None), c[2] + n
                    break
            else:
                chain.append([own, top, n])
        if len(out) >= 4000:
            yield batch(out)
            out.clear()
    flush()
    yield batch(out)


def build_index(spark: SparkSession, docs: DataFrame, ws: Workspace, capacity: int = 4096, max_depth: int = 16) -> tuple[DataFrame, DataFrame, Directory]:
    """(hashed rows, index of chains, directory). docs: doc_id, text."""
    hashed = ws.write(docs.mapInArrow(tidy(_hash_rows), "doc_id long, key long, sha binary"), "rows")
    size = 1 << max_depth
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    counts = np.zeros(size, np.int64)
    for p, n in hashed.groupBy(prefix.cast("int").alias("p")).agg(F.approx_count_distinct("key", 0.05).alias("n")).collect():  # at most 2^max_depth rows
        counts[p] = n
    directory = Directory(counts, max(capacity, int(2 * counts.sum() / size)))
    n = partitions_for(spark, docs)
    slots = spark.createDataFrame([(s, int(o)) for s, o in enumerate(directory.owners(n))], "slot int, owner int")  # at most 2^max_depth rows
    slot = (F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0)).cast("int")
    texts = docs.mapInArrow(tidy(_distinct_texts), "key long, top long, n long, text binary").withColumn("slot", slot).join(F.broadcast(slots), "slot")
    chains = texts.repartitionById(n, F.col("owner")).sortWithinPartitions("key").select("key", "top", "n", "text").mapInArrow(tidy(_chain), "key long, place int, sha binary, keep_id long, group_size long")
    return hashed, ws.write(chains, "index"), directory


def exact_dedup(spark: SparkSession, docs: DataFrame, capacity: int = 4096, max_depth: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    ws = Workspace(spark, "exact")
    docs = plain(docs, "doc_id", "text")
    hashed, index, _ = build_index(spark, docs.withColumn("doc_id", F.col("doc_id").cast("long")), ws, capacity, max_depth)
    n = hashed.count()
    out = join_by_key(hashed.select("doc_id", "sha"), index.select("sha", "keep_id", "group_size"), "sha", "group_size", heavy_at(n))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
