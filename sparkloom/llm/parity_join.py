"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two documents link when den * |A and B| >= num * |A or B|,
so their symmetric difference is at most D = (|A| + |B|) (den - num) / (den + num).

*Sketch.* Every shingle is XORed into one of the words of a sketch. A shingle in only one of two sets changes one word, so the
number of words that differ is at most the symmetric difference (the same holds bit by bit for a parity sketch of 512 bits or more, in which a
shingle flips one bit).

*Pigeonhole join per size band.* Bands are powers of two of the set size; a pair meets in the band of its larger set. Sketches of a
band have the same number of words, enough that a set fills more words than D; so some word that is not empty is equal in both.
All words that are equal number at least n - D of a set's n filled words, hence it suffices to send the first D + 1 in an order that both sets
share: words with most shingles first, which are those least likely to be equal by chance. A set that fills no more than
D words (rare) also sends all its shingles, where it meets the others of its kind.

*Verification.* Sets with an equal word are a candidate group, its smallest member leads. First each set is verified against the
leader that leads most of its groups (if the parity sketches do not rule it out); verified links give components. Groups that
still span several components are then searched whole for pairs across components whose sizes and parity sketches
(Hamming distance at most D) admit a link. A group of more than ``TILE`` members is dealt to tiles of two blocks each, none of which lies
within one component, so it is spread over tasks and a family that is one component already is not compared with itself. In
``CLOSEST_ROUNDS`` (one: a second found nothing new) rounds every component of a group verifies its closest such pair, which
is linear in the group and merges families of near copies; what is still across components after that is verified in full.
So every pair of different sets that links lies in one component, though not all pairs of a group are ever listed.

Equal sets (copies) are one entity throughout: a word is sent once an entity and message. Verification decides on whole shingle sets of the texts.
Shingles are compared by 64-bit hash, entities by a 64-bit hash of the whole set.

Null and empty texts and texts without words have no shingles and link with nothing. Rows without doc_id have no component
(null). Rows that repeat a doc_id are handled each with its own text. Very long texts are shingled whole, one at a time; pairs at the
threshold link. An empty table gives no rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, TextView, Workspace, as_long, heavy_at, join_by_key, mix64, partitions_for, plain, shingles, splitmix, tidy
from sparkloom.llm.components import ONE_TASK, connected_components

SKETCH_BITS = 512
FILTER_SLOTS = 1 << 19
PAIRS_A_TASK = 250
FEW = 200_000
TILE = 1024
CLOSEST_ROUNDS = 1
_SALT = splitmix(128, 0x9A)


class Threshold:
    def __init__(self, num: int = 75, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the threshold num / den must lie in (0, 1]")
        self.num, self.den = num, den

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def differ(self, a, b):
        """Largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def words(self, band: int) -> int:
        """Words of a sketch in a band of sizes below 2^(band + 1): so many that a set most likely fills more than its D."""
        hi = 1 << (band + 1)
        need, x = 1.1 * (self.den - self.num) / self.num, 0.05
        while x * (1 - math.exp(-1 / x)) < need and x < 64:
            x += 0.01
        return math.ceil(x * hi + 1.5 * math.sqrt(hi))


def set_ids(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """64-bit id of each row's shingle set; h distinct within a row."""
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        np.add.at(out, row, mix64(h + U64(0x632BE59BD9B4E019)))
        return mix64(out + np.bincount(row, minlength=n).astype(U64) * U64(0x9E3779B97F4A7C15))


def parity_bits(h: np.ndarray, row: np.ndarray, n: int) -> list[bytes]:
    """Parity sketch of each row: shingle h flips bit h mod m, where m is a power of two of at least ``SKETCH_BITS`` and twice the set's size."""
    size = np.bincount(row, minlength=n)
    width = np.maximum(SKETCH_BITS, 1 << np.frexp(np.maximum(2 * size - 1, 1))[1]).astype(np.int64)
    out: list[bytes] = [b""] * n
    for m in np.unique(width).tolist():
        rows = np.flatnonzero(width == m)
        place = np.full(n, -1)
        for at in range(0, len(rows), max(1, (1 << 20) // m)):
            part = rows[at : at + max(1, (1 << 20) // m)]
            place[:] = -1
            place[part] = np.arange(len(part))
            own = place[row]
            pick = own >= 0
            flips = np.bincount(own[pick] * m + (h[pick] & U64(m - 1)).astype(np.int64), minlength=len(part) * m)
            for r, x in zip(part.tolist(), np.packbits((flips & 1).astype(bool).reshape(len(part), m), axis=1), strict=True):
                out[r] = x.tobytes()
    return out


def fold(sketches: list[bytes], size: int | None = None) -> np.ndarray:
    """Sketches of one width (the least among them, or ``size`` bytes) as rows of 64-bit words; halves of a wider one are XORed."""
    size = size or min(map(len, sketches))
    out = np.empty((len(sketches), size), np.uint8)
    for i, x in enumerate(sketches):
        a = np.frombuffer(x, np.uint8)
        while len(a) > size:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        out[i] = a
    return out.view(U64)


def sketch_keys(h: np.ndarray, row: np.ndarray, n: int, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the words that each set sends. h sorted by row."""
    size = np.bincount(row, minlength=n)
    band = np.frexp(np.maximum(size, 1))[1] - 1
    keys, rows = [], []
    for up in range(64):
        meets = (size > 0) & ((1 << (band + up)) * limit.num <= size * limit.den) if up else size > 0
        if not meets.any():
            break
        for j in np.unique(band[meets]) + up:
            who = meets & (band + up == j)
            pick = np.flatnonzero(who[row])
            hs, rs, words = h[pick], row[pick], limit.words(int(j))
            with np.errstate(over="ignore"):
                word = ((mix64(hs ^ _SALT[j]) >> U64(32)) * U64(words) >> U64(32)).astype(np.int64)
                slot = rs * words + word
                by = np.argsort(slot, kind="stable")
                slot, hs = slot[by], hs[by]
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                value, filled = np.bitwise_xor.reduceat(hs, first), np.diff(np.r_[first, len(slot)])
                r = slot[first] // words
                key = mix64(value + _SALT[j] * ((slot[first] % words).astype(U64) + U64(1)))
            most = np.minimum((1 << (int(j) + 1)) - 1, size * limit.den // limit.num)
            d = limit.differ(size, most)
            by = np.lexsort((key, -filled, r))
            key, r = key[by], r[by]
            start = np.searchsorted(r, np.arange(n + 1))
            rank = np.arange(len(r)) - start[r]
            send = rank <= d[r]
            keys.append(key[send]), rows.append(r[send])
            short = who & (np.diff(start) <= d)  # fills no more than D words
            if short.any():
                pick = np.flatnonzero(short[row])
                with np.errstate(over="ignore"):
                    keys.append(mix64(h[pick] + _SALT[64 + j])), rows.append(row[pick])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))


# ---------------------------------------------------------------- sending words

#: Words that a task gathers before it sends them.
KEYS_A_MESSAGE = 500_000


def _send(limit: Threshold, parts: int, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            view, found = TextView(b.column("text")), []
            for i, j, data, off in view.slices(1 << 18):
                h, row = shingles(data, off, width)
                n = j - i
                ids = set_ids(h, row, n)
                size = np.bincount(row, minlength=n)
                found.append((size, ids, parity_bits(h, row, n)))
                once = np.zeros(n, bool)
                once[np.unique(ids, return_index=True)[1]] = True
                keep = once[row]
                key, r = sketch_keys(h[keep], row[keep], n, limit)
                out.append((key, ids[r]))
                held += len(key)
            size, ids = (np.concatenate([np.zeros(0, t), *[f[k] for f in found]]) for k, t in ((0, np.int64), (1, U64)))
            bits = [x for f in found for x in f[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.arange(len(ids)) % parts).astype(np.int32)), pa.nulls(len(ids), pa.binary()), b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), as_long(ids), pa.array(bits, pa.binary())],
                names=["part", "blob", "doc_id", "n", "ent", "bits"],
            )
            if held > KEYS_A_MESSAGE:
                yield words(out)
                held = 0
        yield words(out)

    def words(out: list) -> pa.RecordBatch:
        """The words of a task so far, each once an entity, a message for each range of words."""
        key, ent = (np.concatenate([np.zeros(0, U64), *x]) for x in (zip(*out, strict=True) if out else ([], [])))
        out.clear()
        part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        by = np.lexsort((ent, key)) if len(key) else part
        key, ent, part = key[by], ent[by], part[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (ent[1:] != ent[:-1])] if len(key) else np.zeros(0, bool)
        key, ent, part = key[new], ent[new], part[new]
        cut = np.searchsorted(part, np.arange(parts + 1))
        msgs = [(q, key[cut[q] : cut[q + 1]].tobytes() + ent[cut[q] : cut[q + 1]].tobytes()) for q in range(parts) if cut[q] < cut[q + 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([q for q, _ in msgs], pa.int32()), pa.array([x for _, x in msgs], pa.binary())] + [pa.nulls(len(msgs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())],
            names=["part", "blob", "doc_id", "n", "ent", "bits"],
        )

    return rows


_FOUND = "kind int, a long, b long, n long, bits binary"


def _found(kind: int, a, b, n=None, bits=None) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), a, b, n if n is not None else pa.nulls(m, pa.int64()), bits if bits is not None else pa.nulls(m, pa.binary())], names=["kind", "a", "b", "n", "bits"])


PAIR, GROUP, DOCUMENT = range(3)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range of keys: documents pass through; words give (smallest member, member) and the groups."""
    blobs = []
    for b in batches:
        is_doc = b.column("ent").is_valid()
        docs = b.filter(is_doc)
        if docs.num_rows:
            yield _found(DOCUMENT, docs.column("doc_id"), docs.column("ent"), docs.column("n"), docs.column("bits"))
        blobs += [np.frombuffer(x, U64).reshape(2, -1) for x in b.column("blob").drop_null().to_pylist()]
    if not blobs:
        return
    key, ent = np.concatenate(blobs, axis=1)
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    met = np.zeros(len(key), bool)
    met[1:] |= same
    met[:-1] |= same
    by = by[met]
    by = by[np.lexsort((ent[by], key[by]))]
    key, ent = key[by], ent[by]
    new = np.r_[True, (key[1:] != key[:-1]) | (ent[1:] != ent[:-1])] if len(key) else np.zeros(0, bool)
    key, ent = key[new], ent[new]
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    lead = np.repeat(ent[first], count)
    pair = np.flatnonzero(lead != ent)
    order = pair[np.lexsort((lead[pair], ent[pair]))]
    a, z = lead[order], ent[order]
    once = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (z[1:] != z[:-1])]) if len(a) else order
    words = np.diff(np.r_[once, len(a)])
    a, z = a[once], z[once]
    for at in range(0, len(a), 100_000):
        yield _found(PAIR, as_long(a[at : at + 100_000]), as_long(z[at : at + 100_000]), pa.array(words[at : at + 100_000], pa.int64()))
    with np.errstate(over="ignore"):
        gid = mix64(np.add.reduceat(mix64(ent), first) + count.astype(U64))  # groups of equal members are one
    once = np.zeros(len(first), bool)
    once[np.unique(gid, return_index=True)[1]] = True
    keep = np.repeat(once & (count > 1), count)
    g, e = np.repeat(gid, count)[keep], ent[keep]
    for at in range(0, len(g), 100_000):
        yield _found(GROUP, as_long(g[at : at + 100_000]), as_long(e[at : at + 100_000]))


# ---------------------------------------------------------------- verification


def _verify(limit: Threshold, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for b in batches:
            view = TextView(b.column("text"))
            a_all, e_all = b.column("lead").to_numpy(), b.column("ent").to_numpy()
            la, le = [], []
            for i, j, data, off in view.slices(1 << 18):
                h, row = shingles(data, off, width)
                ids = set_ids(h, row, j - i).view(np.int64)
                cut = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                for k in range(j - i):
                    a, e = int(a_all[i + k]), int(e_all[i + k])
                    if ids[k] != e:  # another row with this doc_id
                        continue
                    mine = h[cut[k] : cut[k + 1]]
                    if a == e:
                        lead, own = a, mine
                    elif lead == a:
                        at = np.searchsorted(own, mine)
                        at[at == len(own)] = 0
                        if limit.links(int((own[at] == mine).sum()), len(own), len(mine)):
                            la.append(a), le.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(la, pa.int64()), pa.array(le, pa.int64())], names=["a", "b"])

    return rows


def few(table: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows of a few ids: broadcast up to ``FEW`` rows, else joined by a shuffle."""
    return F.broadcast(table) if n <= FEW else table


def verify(spark: SparkSession, ws: Workspace, docs: DataFrame, pairs: DataFrame, entities: DataFrame, limit: Threshold, width: int, name: str) -> DataFrame:
    """The pairs (a, b) of entities that link, written. pairs: a written table. entities: ent, rep (doc_id of one document of the entity)."""
    parts, n = partitions_for(spark, docs), pairs.count()
    heavy = max(PAIRS_A_TASK, n >> 16)  # so at most 65,536 leaders have more pairs
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / heavy).cast("int").alias("fan"))
    members = pairs.join(F.broadcast(fan.where("fan > 1")), "a", "left").select(F.col("a").alias("lead"), F.col("b").alias("ent"), F.pmod(F.xxhash64("b"), F.coalesce("fan", F.lit(1))).cast("int").alias("salt"))
    leads = fan.select(F.col("a").alias("lead"), F.col("a").alias("ent"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    need = ws.write(few(members.unionByName(leads), 2 * n).join(entities.select("ent", "rep"), "ent"), f"{name}-need")
    texts = docs
    if n > FEW:
        # a one-hash filter of at most FILTER_SLOTS rows keeps most documents that no pair needs out of the shuffle of texts
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_SLOTS))
        slots = need.select(slot("rep").alias("slot")).distinct()
        texts = docs.join(F.broadcast(slots), slot("doc_id") == F.col("slot"), "left_semi")
    joined = texts.join(few(need, 2 * n), F.col("doc_id") == F.col("rep")).select("lead", "salt", "ent", "text")
    placed = joined.repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt", F.col("ent") != F.col("lead"))
    return ws.write(placed.select("lead", "ent", "text").mapInArrow(tidy(_verify(limit, width)), "a long, b long"), f"{name}-links")


def _admit(limit: Threshold):
    """Pairs that sizes and parity sketches do not rule out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            x, y = b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()
            for i in np.flatnonzero(np.minimum(n, m) * limit.den >= np.maximum(n, m) * limit.num).tolist():
                size = min(len(x[i]), len(y[i]))
                keep[i] = np.bitwise_count(fold([x[i]], size) ^ fold([y[i]], size)).sum() <= limit.differ(n[i], m[i])
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return rows


def admitted(pairs: DataFrame, entities: DataFrame, limit: Threshold) -> DataFrame:
    side = lambda c: entities.select(F.col("ent").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_admit(limit), "a long, b long")


def tiled(members: DataFrame, n: int, tile: int) -> DataFrame:
    """The ``n`` members (gid, ent, comp, g: size of the group) dealt to tiles: tile, side, gid, ent, comp.

    A group of at most ``tile`` members is a tile. A larger one is cut into blocks: a component of half a tile or more has its own
    blocks, smaller ones are pooled. Two blocks make a tile, unless both are of one component, so a family that is one component
    already costs a copy for each block of others and not the square of its size.
    """
    one = members.where(F.col("g") <= tile).select(F.xxhash64("gid").alias("tile"), F.lit(0).alias("side"), "gid", "ent", "comp")
    big = members.where(F.col("g") > tile)
    pool = F.lit(-1).cast("long")  # names the pooled components' blocks together with ``pooled``
    size = big.groupBy("gid", "comp").agg(F.count("*").alias("c")).withColumn("pooled", F.col("c") * 2 < tile).withColumn("own", F.when(F.col("pooled"), pool).otherwise(F.col("comp")))
    blocks = size.groupBy("gid", "pooled", "own").agg(F.ceil(F.sum("c") / tile).cast("int").alias("fan"))
    homes = size.drop("c").join(few(blocks, 3 * n // tile), ["gid", "pooled", "own"])  # a block holds half a tile or is the last of its group
    placed = big.join(homes, ["gid", "comp"]).withColumn("at", F.pmod(F.xxhash64("ent"), F.col("fan")).cast("int"))
    key = F.xxhash64("own", "pooled", "at")
    each = blocks.select("gid", "pooled", "own", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("at")).select("gid", "pooled", "own", key.alias("k"))
    x, y = (each.select("gid", *[F.col(c).alias(f"{c}_{s}") for c in ("pooled", "own", "k")]) for s in "xy")
    both = F.col("pooled_x") & F.col("pooled_y") & (F.col("k_x") <= F.col("k_y"))
    mixed = F.col("pooled_x") & ~F.col("pooled_y")
    families = ~F.col("pooled_x") & ~F.col("pooled_y") & (F.col("k_x") < F.col("k_y")) & (F.col("own_x") != F.col("own_y"))
    pairs = x.join(y, "gid").where(both | mixed | families).select("gid", F.xxhash64("gid", "k_x", "k_y").alias("tile"), "k_x", "k_y")
    part = lambda side, k: F.struct(F.lit(side).alias("side"), F.col(k).alias("k"))
    pairs = pairs.select("gid", "tile", F.explode(F.when(F.col("k_x") == F.col("k_y"), F.array(part(0, "k_x"))).otherwise(F.array(part(1, "k_x"), part(2, "k_y")))).alias("b"))
    spread = placed.withColumn("k", key).join(pairs.select("gid", "tile", "b.side", "b.k"), ["gid", "k"])
    return one.unionByName(spread.select("tile", "side", "gid", "ent", "comp"))


def _across(limit: Threshold, closest: bool):
    """Pairs across components of a tile whose sizes and sketches admit a link: the closest of each component, or all.

    Rows come sorted by tile. Side 0: all pairs of the tile; sides 1 and 2: one member of each.
    """

    def admit(side, comps, sizes, words):
        n = len(side)
        for at in range(0, n, 64):
            for to in range(at // 1024 * 1024, n, 1024):
                i, j = slice(at, min(at + 64, n)), slice(to, min(to + 1024, n))
                a, b = sizes[i][:, None], sizes[j][None, :]
                ok = (comps[i][:, None] != comps[j][None, :]) & (np.minimum(a, b) * limit.den >= np.maximum(a, b) * limit.num)
                ok &= (side[i][:, None] == 0) | (side[i][:, None] != side[j][None, :])
                p, q = np.nonzero(ok)
                later = p + at < q + to
                p, q = p[later], q[later]
                if len(p):
                    far = np.bitwise_count(words[i][p] ^ words[j][q]).sum(axis=1, dtype=np.int64)
                    good = far <= limit.differ(a[p, 0], b[0, q])
                    yield p[good] + at, q[good] + to, far[good]

    def found(t: pa.Table):
        ents, comps, sizes = (t.column(c).to_numpy() for c in ("ent", "comp", "n"))
        words, side, none = fold(t.column("bits").to_pylist()), t.column("side").to_numpy(), np.iinfo(np.int64).max
        if not closest:
            for p, q, far in admit(side, comps, sizes, words):
                yield np.full(len(p), 0), far, ents[p], ents[q]
            return
        best = np.full(len(ents), none)  # distance, then partner
        for p, q, far in admit(side, comps, sizes, words):
            np.minimum.at(best, p, far << 32 | q)
            np.minimum.at(best, q, far << 32 | p)
        has = np.flatnonzero(best != none)
        by = has[np.lexsort((best[has], comps[has]))]
        first = by[np.r_[True, comps[by][1:] != comps[by][:-1]]] if len(by) else by
        yield comps[first], best[first] >> 32, ents[first], ents[best[first] & 0xFFFFFFFF]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal size
            t = pa.Table.from_batches(held)
            for comp, far, x, y in found(t):
                out.append(np.stack([np.full(len(x), t.column("gid")[0].as_py()), comp, far, np.minimum(x, y), np.maximum(x, y)]))
                size += len(x)
            held.clear()

        def emit():
            nonlocal size
            m = np.concatenate([np.zeros((5, 0), np.int64), *out], axis=1)
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in m], names=["gid", "comp", "far", "a", "b"])

        for b in batches:
            g = b.column("tile").to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(cut, cut[1:], strict=False):
                if x == y:
                    continue
                if held and held[-1].column("tile")[0].as_py() != g[x]:
                    flush()
                held.append(b.slice(x, y - x))
                if size > 500_000:
                    yield emit()
        if held:
            flush()
        yield emit()

    return rows


def jaccard_components(spark: SparkSession, docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, tile: int = TILE, one_task: int = ONE_TASK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs`` (doc_id, text)."""
    ws, limit = Workspace(spark, "parity"), Threshold(num, den)
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = partitions_for(spark, docs)
    sent = docs.mapInArrow(tidy(_send(limit, parts, width)), "part int, blob binary, doc_id long, n long, ent long, bits binary")
    met = ws.write(sent.repartitionById(parts, F.col("part")).mapInArrow(tidy(_meet), _FOUND), "met")
    rows = met.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc_id"), "n", F.col("b").alias("ent"))
    entities = ws.write(met.where((F.col("kind") == DOCUMENT) & (F.col("n") > 0) & F.col("a").isNotNull()).groupBy(F.col("b").alias("ent")).agg(F.min("a").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "entities")
    led = met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("words"))
    pairs = led.groupBy("b").agg(F.max(F.struct("words", "a")).alias("m")).select("m.a", "b")
    texts = docs.where("doc_id IS NOT NULL")
    tried = ws.write(admitted(pairs, entities, limit), "admitted")
    links = verify(spark, ws, texts, tried, entities, limit, width, "first")
    labels = connected_components(spark, ws, links, "first", one_task)

    groups = ws.write(met.where(F.col("kind") == GROUP).select(F.col("a").alias("gid"), F.col("b").alias("ent")).distinct(), "groups")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for k in range(CLOSEST_ROUNDS + 1):
        labelled = groups.join(few(labels.withColumnRenamed("node", "ent"), labels.count()), "ent", "left").select("gid", "ent", F.coalesce("comp", "ent").alias("comp"))
        spans = labelled.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g")).where("lo <> hi").select("gid", "g")
        spans = ws.write(spans, f"spans-{k}")
        groups = ws.write(labelled.join(few(spans, spans.count()), "gid"), f"open-{k}")  # components only grow, so the other groups are done
        n, most = groups.agg(F.count("*"), F.max("g")).first()
        if not n:
            break
        dealt = tiled(groups, n, tile) if most > tile else groups.select(F.col("gid").alias("tile"), F.lit(0).alias("side"), "gid", "ent", "comp")
        members = few(dealt, 2 * n if most <= tile else FEW + 1).join(entities.select("ent", "n", "bits"), "ent").repartition(parts, "tile").sortWithinPartitions("tile").select("tile", "side", "gid", "ent", "comp", "n", "bits")
        said = ws.write(members.mapInArrow(tidy(_across(limit, k < CLOSEST_ROUNDS)), "gid long, comp long, far long, a long, b long"), f"said-{k}")
        n = said.count()
        if not n:
            break
        groups = groups.join(few(said.select("gid").distinct(), n), "gid", "left_semi").select("gid", "ent")
        if k < CLOSEST_ROUNDS and most > tile:  # the closest of the tiles' closest
            said = said.groupBy("gid", "comp").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b")
        new = said.select("a", "b").distinct()
        across = ws.write(few(new, n).join(tried, ["a", "b"], "left_anti") if n > FEW else _without(new, tried), f"across-{k}")
        if across.isEmpty():
            continue  # nothing new is close; the last round still searches in full
        tried = tried.unionByName(across)
        links = links.unionByName(verify(spark, ws, texts, across, entities, limit, width, f"round-{k}"))
        labels = connected_components(spark, ws, links, f"cc-{k}", one_task)

    labelled = entities.join(few(labels.withColumnRenamed("node", "ent"), labels.count()), "ent", "left").select("ent", "rep", "copies", F.coalesce("comp", "ent").alias("comp"))
    n = rows.count()
    smallest = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = ws.write(join_by_key(labelled, smallest, "comp", "members", heavy_at(n)).select("ent", "copies", "component_id"), "named")
    linked = join_by_key(rows.where("n > 0 AND doc_id IS NOT NULL"), named, "ent", "copies", heavy_at(n)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _without(new: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs of ``new``, at most ``FEW``, that are not in ``tried``: only those of ``tried`` that are in ``new`` are compared."""
    again = tried.join(F.broadcast(new), ["a", "b"], "left_semi").distinct()
    return new.join(F.broadcast(again), ["a", "b"], "left_anti")
