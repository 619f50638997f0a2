"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, into classes up to 8, 16, 32, 64, ... A short item inside a long
document has a tiny Jaccard similarity to it, so for each class that occurs a document is read in windows of twice the class's size
that step by its size: any passage of an item lies within one window, of which it is half or so. Windows are summarised by MinHash
with one permutation and 128 places (the least hash in each place); blocks of 16 shingles are hashed once, larger windows are
minima of smaller ones. A window and an item that share a place's minimum are a candidate pair; with 0.75 of 9 shingles
contained the chance to share none is below 1e-6. Sets of up to 8 shingles are summarised by all their hashes, so nothing is missed there.

Candidates are verified at once in the same task: the part of the item's distinct shingles that the whole document holds must be
at least ``num / den``. Documents are not shuffled.

Items go to the tasks in blocks of at most about ``ITEM_BLOCK`` items, a pass over the documents a block, so a benchmark of any size works.

Shingles are of 5 words, A-Z lowered; a text with fewer words is one shingle. Null or empty items and documents match nothing. Repeated
doc_ids or item_ids each give their matches, and so do null ones. Very long texts are read whole, window by window; a containment at
the threshold counts. Empty tables give no rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, TextView, plain, shingle_sequence, shingles, tidy

BASE, PLACES, ITEM_BLOCK = 16, 128, 20_000
NONE = U64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Hash -> items, with a bitmap in front."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        by = np.lexsort((items, hashes))
        self.hashes, self.items = hashes[by], items[by]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(hashes >> U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, items) of the equal hashes."""
        at = np.flatnonzero(self.bitmap[(h >> U64(44)).astype(np.int64)])
        h, row = h[at], row[at]
        a, z = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        n = z - a
        return np.repeat(row, n), self.items[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else row


class Items:
    """Signatures of the test items by size class, and their shingle sets."""

    def __init__(self, texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        h, row = shingles(np.frombuffer(b"".join(raw), np.uint8), off)
        cut = np.searchsorted(row, np.arange(len(raw) + 1))
        self.sets = [h[cut[i] : cut[i + 1]] for i in range(len(raw))]
        parts: dict[int, list] = {}
        for i, s in enumerate(self.sets):
            if len(s) == 0:
                continue
            level = -1 if len(s) <= BASE // 2 else max(0, int(len(s) - 1).bit_length() - BASE.bit_length() + 1)
            if level >= 0:
                place = (s & U64(PLACES - 1)).astype(np.int64)
                sig = np.full(PLACES, NONE)
                np.minimum.at(sig, place, s)
                s = sig[sig != NONE]
            parts.setdefault(level, []).append((s, np.full(len(s), i)))
        self.classes = {k: Lookup(*(np.concatenate(x) for x in zip(*v, strict=True))) for k, v in parts.items()}

    def candidates(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Distinct (row, item) pairs as one sorted code; h in text order."""
        found = []
        if -1 in self.classes:
            found.append(self.classes[-1].find(h, row))
        if len(h) and (top := max(self.classes, default=-1)) >= 0:
            count = np.bincount(row, minlength=n)
            at = np.arange(len(h)) - np.r_[0, np.cumsum(count)[:-1]][row]
            blocks = -(-count // BASE)
            first = np.r_[0, np.cumsum(blocks)]
            table = np.full((first[-1], PLACES), NONE)
            np.minimum.at(table, (first[row] + at // BASE, (h & U64(PLACES - 1)).astype(np.int64)), h)
            for level in range(top + 1):
                owner = np.repeat(np.arange(n), blocks)
                if level in self.classes:
                    window = table.copy()
                    pair = np.flatnonzero(owner[1:] == owner[:-1])
                    window[pair] = np.minimum(window[pair], table[pair + 1])
                    full = window != NONE
                    found.append(self.classes[level].find(window[full], np.broadcast_to(owner[:, None], window.shape)[full]))
                half = -(-blocks // 2)  # the next class's blocks are pairs of these
                start = np.r_[0, np.cumsum(half)]
                who = np.repeat(np.arange(n), half)
                left = first[who] + 2 * (np.arange(start[-1]) - start[who])
                right = np.minimum(left + 1, first[who + 1] - 1)
                table, blocks, first = np.minimum(table[left], table[right]), half, start
        rows, items = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return np.unique(rows * len(self.sets) + items)


def _search(items: Items, ids: list, num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view, out = TextView(b.column("text")), []
            docs = b.column("doc_id").cast(pa.int64()).to_pylist()
            for i, j, data, off in view.slices(1 << 18):
                h, row = shingle_sequence(data, off)
                codes = items.candidates(h, row, j - i)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                last, own = -1, None
                for code in codes.tolist():
                    k, item = divmod(code, len(items.sets))
                    if k != last:
                        last, own = k, np.unique(h[cut[k] : cut[k + 1]])
                    want = items.sets[item]
                    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    common = int((own[at] == want).sum())
                    if common * den >= len(want) * num:
                        out.append((docs[i + k], ids[item], len(want), common))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "n_item", "n_common"])

    return rows


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment for every document and test item it contains. docs: doc_id, text; benchmark: item_id, text."""
    docs, benchmark = plain(docs, "doc_id", "text"), plain(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["b"] // (16 << 20)))
    found = []
    for k in range(blocks):
        got = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # a block of bounded size
        found.append(docs.mapInArrow(tidy(_search(Items([r["text"] for r in got]), [r["item_id"] for r in got], num, den)), "doc_id long, item_id long, n_item long, n_common long"))
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_common") / F.col("n_item"))
