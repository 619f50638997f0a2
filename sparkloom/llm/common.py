"""What the operators of this subpackage share: workspace on shared storage, Arrow text views, hashing.

Text columns reach Python as Arrow buffers and stay there: ``TextView`` gives the bytes of a batch
as one numpy array plus offsets, and ``slices`` cuts a batch so that working memory is bounded by
``SLICE_BYTES`` (one document longer than that is a slice of its own).
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64


# ---------------------------------------------------------------- shared storage


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


class Workspace:
    """A run's own folder below the shared root. ``close()`` removes it once the results are consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/sparkloom/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write as Parquet on shared storage and read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    close = drop


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write under an attempt's own name, then rename: a retried or speculative task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        write(out)
    try:
        fs.move(temp, path)
    except OSError:  # some file systems do not replace; the file there came whole from another attempt at the same rows
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


def get_file(uri: str) -> pa.Buffer:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_buffer()


PART_BYTES = 64 << 20


def partitions_for(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Shuffle partitions as set, and more where the planner's estimate of the size of ``docs`` needs them (at most 256 times as many)."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return n
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size >= 1 << 60 else max(n, min(256 * n, size // PART_BYTES))  # the planner says 2^63 - 1 where it knows nothing


def settled(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` itself if it comes from a scan, whose retried tasks read the same rows in the same order; else written down first."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return ws.write(docs, "input") if any(x in plan for x in ("Exchange", "ExistingRDD", "MapInArrow", "Python", "Pandas")) else docs


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Where the session has Spark's 10,000 rows an Arrow batch, 2,500: texts are long, and every running task holds batches on both sides."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2500")


def plain(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns only, taken by exact name so that extra columns of clashing case cannot interfere."""
    small_batches(docs.sparkSession)
    out = []
    for c in cols:
        if c not in docs.columns:
            raise ValueError(f"column {c!r} is missing; found {docs.columns}")
        same = [i for i, x in enumerate(docs.columns) if x.lower() == c.lower()]
        out.append(docs[f"`{c}`"] if len(same) == 1 else None)
    if any(c is None for c in out):  # names that differ only in case: rename by position first
        named = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
        return named.select(*[F.col(f"_{docs.columns.index(c)}").alias(c) for c in cols])
    return docs.select(*[c.alias(n) for c, n in zip(out, cols, strict=True)])


# ---------------------------------------------------------------- joins with hot keys


def join_by_key(left: DataFrame, right: DataFrame, key: str, weight: str, heavy_at: int) -> DataFrame:
    """left join of ``left`` with ``right``, whose ``key`` is unique and whose ``weight`` counts the left rows of a key.

    Keys with at least ``heavy_at`` left rows are joined by broadcast: with N left rows there are at
    most N / heavy_at of them, so ``heavy_at = max(1000, N / 4096)`` bounds the broadcast at 4096 rows. All other
    keys are joined by an ordinary shuffle, where no key has ``heavy_at`` rows or more.
    """
    cols = [c for c in right.columns if c != key]
    hot = F.broadcast(right.where(F.col(weight) >= heavy_at).select(key, *[F.col(c).alias(f"_hot_{c}") for c in cols]))
    flagged = left.join(hot, key, "left")
    is_hot = F.col(f"_hot_{weight}").isNotNull()
    done = flagged.where(is_hot).select(*left.columns, *[F.col(f"_hot_{c}").alias(c) for c in cols])
    rest = flagged.where(~is_hot).select(*left.columns).join(right.where(F.col(weight) < heavy_at), key, "left")
    return done.unionByName(rest.select(*left.columns, *cols))


def heavy_at(n: int) -> int:
    return max(1000, n // 4096)


def smallest_hashes(rows: DataFrame, key: Column, n: int, k: int) -> DataFrame:
    """Those of the ``n`` rows whose 64-bit hash ``key`` is below a threshold that about k + 6 sqrt(k) of them pass.

    Tasks then send little more than k rows in all to whatever sorts them and takes the k smallest.
    """
    want = k + 6 * k**0.5 + 20
    return rows if n <= want else rows.where(key < F.lit(int(-(2**63) + 2**64 * (want / n))))


def release_memory() -> None:
    """Give what a task no longer uses back to the system, because Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(rows):
    """Wrap a function for mapInArrow: memory is released when its task has given all rows."""

    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            release_memory()

    return run


# ---------------------------------------------------------------- Arrow text views


class TextView:
    """Bytes of a string column of a batch (null counts as empty): ``data`` uint8, ``offsets`` int64 (n + 1)."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
        if column.null_count:
            column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, data, offsets from 0) with at most ``limit`` bytes, one row at least."""
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1)
            yield i, j, self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            i = j


# ---------------------------------------------------------------- hashing


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_CODE = splitmix(256, 0x51)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P, _PINV = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
KEPT_POWERS = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n; kept per process up to ``KEPT_POWERS``."""

    def made(base: int, size: int) -> np.ndarray:
        out = np.ones(1, U64)
        with np.errstate(over="ignore"):
            while len(out) < size:
                out = np.concatenate([out, out[: size - len(out)] * U64(pow(base, len(out), 1 << 64))])
        return out

    if n > KEPT_POWERS:
        return made(_P, n), made(_PINV, n)
    if not _POWERS:
        _POWERS.update(p=made(_P, KEPT_POWERS), q=made(_PINV, KEPT_POWERS))
    return _POWERS["p"][:n], _POWERS["q"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each A-Z-lowered word ``[^\\x20\\x09-\\x0D]+`` of each row, and the row of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = ~IS_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a row's end also ends a word
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:n]))
    ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    p, q = powers(n)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[LOWER[data]] * p, out=acc[1:])
        h = mix64((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(offsets, starts, "right") - 1


WIDTH_CODE = splitmix(64, 0x77)


def shingle_sequence(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of the ``width``-word shingle at each word, and its row, in the order of the texts.

    A row with fewer words gives its whole sequence as one shingle; a row without words gives none.
    """
    h, row = word_hashes(data, offsets)
    if not len(h):
        return h, row
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.r_[0, np.cumsum(count)[:-1]]
    wide = np.minimum(count[row], width)
    idx = np.flatnonzero(np.arange(len(h)) - first[row] + wide <= count[row])
    wide = wide[idx]
    with np.errstate(over="ignore"):
        acc = wide.astype(U64) * U64(0xA24BAED4963EE407)
        for k in range(width):
            at = np.minimum(idx + k, len(h) - 1)
            acc = np.where(k < wide, (acc ^ mix64(h[at] + WIDTH_CODE[k])) * U64(0x9FB21C651E98DF25), acc)
        return mix64(acc), row[idx]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by (row, hash)."""
    acc, rows = shingle_sequence(data, offsets, width)
    if not len(acc):
        return acc, rows
    order = np.lexsort((acc, rows))
    acc, rows = acc[order], rows[order]
    new = np.r_[True, (acc[1:] != acc[:-1]) | (rows[1:] != rows[:-1])]
    return acc[new], rows[new]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lowered_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
