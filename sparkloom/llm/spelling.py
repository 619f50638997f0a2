"""Spelling variants of a corpus's words: each word's near words, the frequent form it stands for, and where its forms lead.

Words are maximal runs of letters, counted over all texts. Two words are near if one inserted, deleted or replaced code point makes the
one of the other. No pairs are made:

* a word of L code points belongs to L wildcard groups (position, prefix, suffix), one for each place left open. Two words that differ by a
  replacement share exactly one group; a group has as many words as there are letters at most. Of a group its size and its two best
  words are kept: a word's best partner there is the best, or the second where it is the best itself;
* a word also gives its deletions (distinct strings with one code point less), which meet the vocabulary: the shorter word gets the number and the
  best of the longer ones, a longer one gets the shorter. A string has at most (L + 1) x letters words above it.

A word is known by its rank (most frequent first, ties by code points), numbered in ranges, so best means smallest rank and groups move numbers, not words.
Keys longer than ``LONG`` code points are replaced by 128-bit hashes of prefix and suffix, so that a run of a million letters costs a million
short keys; for such words equality rests on the hash.

Texts are read once, in slices; each task counts words in a bounded dictionary. Null texts are empty. A row without doc_id counts as the doc_id
``null`` for the deletions. Repeated rows count each time. An empty table gives no rows. Extra columns, also such whose names differ only in case,
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, SLICE_BYTES, U64, TextView, Workspace, mix64, partitions_for, plain, powers, splitmix, tidy
from sparkloom.operators.numbering import numbered

SHORTEST, LEAST, RATIO, LONG = 7, 2, 10, 64
COUNTED = 200_000  # distinct words a task remembers before it sends its counts on
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3] = True  # U+00C0 to U+00FF are 0xC3 and one continuation byte
NO_LETTER = ~LETTER & (np.arange(256) < 128)


def letter_runs(data: np.ndarray, offsets: np.ndarray, least: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, code points and rows of the maximal runs of letters of at least ``least`` code points."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    inside = LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:n]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    more = np.r_[0, np.cumsum((data & 0xC0) == 0x80)]
    size = ends - starts - (more[ends] - more[starts])
    long = size >= least
    starts = starts[long]
    return starts, ends[long], size[long], np.searchsorted(offsets, starts, "right") - 1


def pieces(view: TextView, limit: int = SLICE_BYTES, stop: np.ndarray = NO_LETTER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, data, offsets) of at most ``limit`` bytes; a longer text is cut before a byte in ``stop``."""
    for i, _, data, off in view.slices(limit):
        at, n = 0, len(data)
        while n - at > limit and len(off) == 2:
            to = at + limit
            while to < n and not stop[data[to]]:
                found = np.flatnonzero(stop[data[to : to + 4096]])
                to = to + int(found[0]) if len(found) else min(n, to + 4096)
            yield i, data[at:to], np.array([0, to - at])
            at = to
        yield i, data[at:], off if len(off) > 2 else np.array([0, n - at])


def misspelt(word: bytes, crc: int, size: int, every: int) -> bytes:
    """The word, without its code point number crc % size where ``every`` divides ``crc``."""
    if crc % every:
        return word
    k = crc % size
    if len(word) == size:
        return word[:k] + word[k + 1 :]
    text = word.decode()
    return (text[:k] + text[k + 1 :]).encode()


def count_words(docs: DataFrame, least: int = SHORTEST, every: int = 31) -> DataFrame:
    """word, n: letter runs, A-Z lowered, of at least ``least`` code points after the deletions that a hash of (doc_id, run) decides."""

    def batch(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            heads = [zlib.crc32(b"null:" if d is None else b"%d:" % d) for d in b.column("doc_id").cast(pa.int64()).to_pylist()]
            for i, data, off in pieces(TextView(b.column("text"))):
                starts, ends, sizes, owner = letter_runs(data, off, least)
                raw = LOWER[data].tobytes()
                for a, z, size, k in zip(starts.tolist(), ends.tolist(), sizes.tolist(), owner.tolist(), strict=True):
                    word = raw[a:z]
                    crc = zlib.crc32(word, heads[i + k])
                    if crc % every == 0:
                        if size == least:
                            continue
                        word = misspelt(word, crc, size, every)
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) >= COUNTED:
                    yield batch(counts)
                    counts = {}
        yield batch(counts)

    made = plain(docs, "doc_id", "text").mapInArrow(tidy(rows), "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- keys of near words


def cut_at(word: Column, k: Column, fill: str) -> Column:
    """The word with ``fill`` in place of its k-th code point (from 1)."""
    return F.concat(F.substring(word, F.lit(1), k - 1), F.lit(fill), F.substring(word, k + 1, F.length(word)))


def short_keys(words: DataFrame, long: int, least: int) -> DataFrame:
    """(key, place, rank): place 0 for the word itself, 1 for a deletion, and for wildcards the key holds an asterisk."""
    w, n = F.col("word"), F.length("word")
    each = F.sequence(F.lit(1), n)
    key = lambda c, kind: F.struct(c.alias("key"), F.lit(kind).alias("place"))
    none = F.array().cast("array<struct<key:string,place:int>>")
    own = F.when(n <= long, F.array(key(w, 0))).otherwise(none)
    wild = F.when(n <= long, F.transform(each, lambda k: key(cut_at(w, k, "*"), 2))).otherwise(none)
    less = F.when((n <= long + 1) & (n > least), F.transform(F.array_distinct(F.transform(each, lambda k: cut_at(w, k, ""))), lambda d: key(d, 1))).otherwise(none)
    return words.select("rank", F.inline(F.concat(own, wild, less))).select(F.col("key").cast("binary").alias("key"), "place", "rank")


CODE = [splitmix(1 << 16, seed) for seed in (0xA1, 0xB2)]


def long_keys(words: DataFrame, long: int, block: int = 1 << 16) -> DataFrame:
    """The same keys of more than ``long`` code points, as two 64-bit hashes of what is left and of what stands at which place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, rank in zip(b.column("word").to_pylist(), b.column("rank").to_pylist(), strict=True):
                c = np.frombuffer(word.encode("utf-16-le"), np.uint16)
                n = len(c)
                p = powers(n)[0]
                with np.errstate(over="ignore"):
                    # before[i]: sum of the first i code points at their places; after[i]: of those behind i, each moved one place down
                    sums = [(np.r_[U64(0), np.cumsum(t[c] * p)], np.r_[U64(0), np.cumsum(t[c[1:]] * p[:-1])] if n > 1 else np.zeros(1, U64), t[c] * p) for t in CODE]
                    hashes = {0: [s[-1:] for s, _, _ in sums] if n > long else None}
                    if n > long:
                        hashes[2] = [s[-1] - own for s, _, own in sums]
                    if n > long + 1:
                        drop = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])  # of equal neighbours the first: the deletions are distinct
                        hashes[1] = [s[drop] + (moved[-1] - moved[drop]) for s, moved, _ in sums]
                for place, both in hashes.items():
                    if both is None:
                        continue
                    where = np.arange(n, dtype=U64) if place == 2 else np.zeros(len(both[0]), U64)
                    size = n - (place == 1)
                    with np.errstate(over="ignore"):
                        h = np.stack([mix64(x + where * U64(0x9E3779B97F4A7C15) + U64(2 * size + (place == 2))) for x in both], 1)
                    for at in range(0, len(h), block):
                        part = np.ascontiguousarray(h[at : at + block])
                        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(part), place, np.int32)), pa.array(np.full(len(part), rank, np.int64))], names=["key", "place", "rank"])

    return words.where(F.length("word") > long).select("word", "rank").mapInArrow(tidy(rows), "key binary, place int, rank long")


def near_words(words: DataFrame, long: int = LONG, least: int = SHORTEST) -> DataFrame:
    """rank, n_near, best (rank of the best near word) of the words (word, rank) that have near words."""
    keys = short_keys(words, long, least).unionByName(long_keys(words, long))
    group = Window.partitionBy("key")
    by_rank, size = group.orderBy("place", "rank"), F.count("*").over(group)
    first, second = F.first("rank").over(by_rank), F.lead("rank").over(by_rank)
    # a wildcard group: the best, for the best itself the second. Else the word itself comes first, then those above it, best first
    wild = F.col("place") == 2
    head = F.row_number().over(by_rank) == 1
    seen = keys.select("place", "rank", size.alias("_size"), first.alias("_first"), second.alias("_second"), head.alias("_head"), F.min("place").over(group).alias("_least")).where("_size > 1 AND _least <> 1")
    count = F.when(wild | (F.col("place") == 0), F.col("_size") - 1).otherwise(1)
    best = F.when(F.col("_head"), F.col("_second")).otherwise(F.col("_first"))
    return seen.select("rank", count.alias("_n"), best.alias("_best")).groupBy("rank").agg(F.sum("_n").alias("n_near"), F.min("_best").alias("best"))


# ---------------------------------------------------------------- forms and roots


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """rank, root of the words (rank, best) that have a form. Each round doubles the steps; n grows with every step, so chains end."""
    at = ws.write(forms.select("rank", F.col("best").alias("root")), "root-0")
    k = 0
    while True:
        k += 1
        step = at.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        at = ws.write(at.join(step, "root", "left").select("rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"root-{k}")
        if at.where("_moved").isEmpty():
            return at.drop("_moved")
        at = at.drop("_moved")


def spelling_variants(spark: SparkSession, docs: DataFrame, least: int = SHORTEST, times: int = LEAST, ratio: int = RATIO, every: int = 31, long: int = LONG) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word with ``times`` or more occurrences in ``docs`` (doc_id, text).

    A word's form is its near word of largest n (ties: smallest in code points) if that has at least ``ratio`` times its n. ``root`` is the
    last word that forms lead to, the word itself where it has none.
    """
    ws = Workspace(spark, "spelling")
    counted = count_words(docs, least, every).where(F.col("n") >= times)
    ranked = numbered(counted, [F.desc("n"), F.asc("word")], "rank", parts=partitions_for(spark, docs), write=lambda df: ws.write(df, "words"))
    words = ws.write(ranked, "ranked")
    near = near_words(words, long, least)
    of_best = words.select(F.col("rank").alias("best"), F.col("n").alias("form_n"))
    joined = words.join(near.join(of_best, "best"), "rank", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    judged = ws.write(joined.select("rank", "n", "word", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("best"), F.when(has, F.col("form_n")).alias("form_n")), "judged")
    chains = roots(ws, judged.where("best IS NOT NULL"))
    name = lambda key, out: words.select(F.col("rank").alias(key), F.col("word").alias(out))
    named = chains.join(judged.select("rank", "best"), "rank").join(name("best", "form"), "best").join(name("root", "_root"), "root").select("rank", "form", "_root")
    return judged.join(named, "rank", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
