"""Token-ID output as length-delimited binary records with masked checksums and a separate offset index.

A shard ``part-00007-0000.tfr`` is a run of records in ascending doc_id order, in the public TFRecord framing, little-endian:

    uint64 length of the payload | uint32 masked CRC-32C of those 8 bytes | payload | uint32 masked CRC-32C of the payload

The payload of a document: int64 doc_id, uint8 width (2 or 4 bytes an id: 2 where the vocabulary fits), uint8 1 if the doc_id is
null, 6 zero bytes, then its ids. ``part-00007-0000.idx`` holds, for reads in any order, one row a record: int64 doc_id, int64 byte
offset, int64 number of ids; all three columns one after another behind an int64 row count. Readers fetch byte ranges only.
Masking is the usual rotation by 15 bits plus 0xA282EAD8.

Texts are range-partitioned by doc_id on quantiles of the doc_id column alone; each task sorts, encodes and writes a new shard
every ``SHARD_BYTES``, under an attempt's own name and then renamed, so a lost executor leaves no torn shard. Global starts come from
the shards' totals (a row a shard). Very long texts are encoded one at a time.

Null and empty texts: a record with only the end id. Rows that repeat a doc_id, which may fill several ranges, are all written, in order of
a hash of their text, then of the text. Rows whose doc_id is null come first (in the index with -2^63). An empty table writes
no records and gives no rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import BYTE_CODE, IS_GAP, U64, TextView, Workspace, filesystem, get_file, mix64, partitions_for, plain, powers, put_file, tidy

NO_ID = -(1 << 63)
SHARD_BYTES, READ_BYTES, CODE_BYTES = 256 << 20, 4 << 20, 1 << 19

# ---------------------------------------------------------------- CRC-32C


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_T = _byte_table()
_BLOCK = 256


def _advance(state: np.ndarray) -> np.ndarray:
    return _T[state & 0xFF] ^ (state >> 8)


def _position_table() -> np.ndarray:
    """[i, b]: what byte b at place i of a block adds to the state at the block's end."""
    out = np.empty((_BLOCK, 256), np.uint32)
    out[-1] = _T
    for i in range(_BLOCK - 2, -1, -1):
        out[i] = _advance(out[i + 1])
    return out


def _shift_tables() -> np.ndarray:
    """[k, b]: a state's byte k of value b carried over a whole block of zero bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(_BLOCK):
        state = _advance(state)
    return state.reshape(4, 256)


_POS, _SHIFT = _position_table().ravel(), _shift_tables()
_CARRY = [t.tolist() for t in _SHIFT]
_PLACE = (np.arange(_BLOCK) * 256).astype(np.int32)
_PART = 1 << 21


def crc32c_many(items: list[bytes]) -> list[int]:
    """CRC-32C of each item: all bytes of all blocks by table look-ups at once, then block after block by linearity.

    An item is padded in front to whole blocks; zeros there leave a state of zero, and the initial state is XORed into its first
    four bytes. Items of fewer than four bytes go byte by byte.
    """
    out = [0] * len(items)
    at = 0
    while at < len(items):
        to, size, where = at, 0, []
        while to < len(items) and (to == at or size + len(items[to]) < _PART):
            blocks = -(-len(items[to]) // _BLOCK) if len(items[to]) >= 4 else 0
            where.append((size, blocks))
            size += blocks * _BLOCK
            to += 1
        buf = bytearray(size)
        for x, (first, blocks) in zip(items[at:to], where, strict=True):
            if blocks:
                buf[first + blocks * _BLOCK - len(x) : first + blocks * _BLOCK] = x
        a = np.frombuffer(buf, np.uint8)
        starts = np.array([first + blocks * _BLOCK - len(x) for x, (first, blocks) in zip(items[at:to], where, strict=True) if blocks], np.int64)
        for k in range(4):
            a[starts + k] ^= 0xFF
        parts: list[int] = []
        for k in range(0, size // _BLOCK, 4096):
            m = a[k * _BLOCK : (k + 4096) * _BLOCK].reshape(-1, _BLOCK)
            parts += np.bitwise_xor.reduce(_POS.take(m + _PLACE), axis=1).tolist()
        c0, c1, c2, c3 = _CARRY
        for i, (first, blocks) in enumerate(where):
            state = 0
            if blocks:
                for p in parts[first // _BLOCK : first // _BLOCK + blocks]:
                    state = c0[state & 255] ^ c1[state >> 8 & 255] ^ c2[state >> 16 & 255] ^ c3[state >> 24] ^ p
            else:
                state = 0xFFFFFFFF
                for b in items[at + i]:
                    state = int(_T[(state ^ b) & 255]) ^ state >> 8
            out[at + i] = state ^ 0xFFFFFFFF
        at = to
    return out


def crc32c(data: bytes) -> int:
    return crc32c_many([data])[0]


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    sums = crc32c_many(heads + payloads)
    n = len(payloads)
    return [b"".join((heads[i], masked(sums[i]).to_bytes(4, "little"), p, masked(sums[n + i]).to_bytes(4, "little"))) for i, p in enumerate(payloads)]


def unframe(buf: memoryview, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at the byte offsets; every checksum is verified."""
    heads = [bytes(buf[at : at + 8]) for at in offsets]
    sizes = [int.from_bytes(h, "little") for h in heads]
    for at, h, s in zip(offsets, heads, crc32c_many(heads), strict=True):
        if masked(s) != int.from_bytes(buf[at + 8 : at + 12], "little"):
            raise ValueError(f"length checksum differs at byte {at}")
    payloads = [bytes(buf[at + 12 : at + 12 + n]) for at, n in zip(offsets, sizes, strict=True)]
    for at, n, p, s in zip(offsets, sizes, payloads, crc32c_many(payloads), strict=True):
        if len(p) != n or masked(s) != int.from_bytes(buf[at + 12 + n : at + 16 + n], "little"):
            raise ValueError(f"payload checksum differs at byte {at}")
    return payloads


# ---------------------------------------------------------------- encoding


_ODD = np.zeros(256, bool)
_ODD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 of the white space beyond ASCII, and control characters that libraries class differently.
_ODD_STARTS = tuple(c.encode() for c in "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def uncut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row must be encoded whole: white space beside a space, at its edge, or beyond the plain kind."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    if len(data):
        gap = IS_GAP[data]
        beside = np.flatnonzero(gap[:-1] & gap[1:])
        beside = beside[(data[beside] == 0x20) | (data[beside + 1] == 0x20)]
        odd = np.flatnonzero(_ODD[data])
        if len(odd):
            raw = data.tobytes()
            odd = np.array([i for i in odd.tolist() if raw.startswith(_ODD_STARTS, i)], np.int64)
        out[np.searchsorted(offsets, np.r_[beside, odd], "right") - 1] = True
        full = np.flatnonzero(np.diff(offsets))
        out[full] |= (data[offsets[full]] == 0x20) | (data[offsets[full + 1] - 1] == 0x20)
    return out


class UnitEncoder:
    """ids of texts as little-endian bytes, by the tokenizers library, with a memo of units.

    A text is cut before each single space that stands between two characters that are no white space; in byte-level
    vocabularies a token starts there and nothing before or behind it looks across. A unit of plain letters, digits, marks other
    than the apostrophe, and single line feeds between them, is asked for in these parts, which such a vocabulary's pattern never
    joins. Texts where white space meets
    a space, with special strings, or with code points that libraries class differently, are encoded whole.
    The memo lives as long as the worker process and only saves time: arrays of units and ids behind a table of hashes, so all units of
    a slice are hashed, looked up, compared byte by byte and replaced by their ids at once. It stops growing at ``MEMO`` units, and
    starts anew where a slice finds less than ``STALE`` of its units in a full one.
    """

    MEMO, LONGEST, STALE, SLOTS = 600_000, 40, 0.7, 1 << 22
    PARTS = re.compile(rb"[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
    PLAIN = re.compile(rb"[A-Za-z]+(?>[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?![\n\s]|\Z))+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype, self.code = np.dtype("<u2" if self.width == 2 else "<u4"), "H" if self.width == 2 else "I"
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.cuts = self._ids([b"ab cd.##"])[0] == b"".join(self._ids([b"ab", b" cd", b".##"]))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.lengths[i] = len(t)
        self._forget()
        self.inner: dict[bytes, bytes] = {}  # of parts that do not begin a unit
        probe = [b"ab", b".#", b"\n", b"Cd", b"12", b"("]
        self.parts = self._ids([b"".join(probe)])[0] == b"".join(self._ids(probe))

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _learn_joined(self, ask: list[bytes]) -> dict[bytes, bytes]:
        """Units with their spaces, many in one text: a token ends where a unit does, and tokens are as long as their bytes."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(ask), 4000):
            part = ask[at : at + 4000]
            found = self.tok.encode_batch_fast([(b" " + b" ".join(part)).decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            ids = np.array(found, self.dtype)
            ends = np.cumsum([len(u) + 1 for u in part])
            upto = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(upto, ends)
            if len(ids) == 0 or upto[-1] != ends[-1] or (upto[cut] != ends).any():  # not a byte-level vocabulary, or invalid text
                out.update(zip(part, self._ids([b" " + u for u in part]), strict=True))
                continue
            raw, w = ids.tobytes(), self.width
            a = 0
            for u, z in zip(part, ((cut + 1) * w).tolist(), strict=True):
                out[u] = raw[a:z]
                a = z
        return out

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of units that no memo has."""
        split = {u: self.PARTS.findall(u) for u in new if self.parts and self.PLAIN.fullmatch(u)}
        split = {u: p for u, p in split.items() if len(p) > 1}
        inner = list({x for p in split.values() for x in p[1:]}.difference(self.inner))
        for at in range(0, len(inner), 4000):
            part = inner[at : at + 4000]
            self.inner.update(zip(part, self._ids(part), strict=True))
        ask = {p[0] for p in split.values()}
        ask.update(new.difference(split))
        found = self._learn_joined(list(ask))
        for u, p in split.items():
            found[u] = found[p[0]] + b"".join(map(self.inner.__getitem__, p[1:]))
        if len(self.inner) > self.MEMO // 4:
            self.inner.clear()
        return found

    def _grow(self, units: list[tuple[bytes, bool]], coded: list[bytes]) -> np.ndarray:
        """Append entries (behind ``self.n``, which the caller moves); returns their numbers."""
        k = len(units)
        at = np.arange(self.n, self.n + k)
        if self.n + k > len(self.unit_len):
            more = max(k, len(self.unit_len))
            for name in ("unit_at", "unit_len", "ids_at", "ids_len"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(more, np.int64)]))
        for pool, starts, sizes, items, dtype in (("bytes", "unit_at", "unit_len", [u for u, _ in units], np.uint8), ("ids", "ids_at", "ids_len", coded, self.dtype)):
            begin, own, add = getattr(self, starts), getattr(self, sizes), np.frombuffer(b"".join(items), dtype)
            first = int(begin[self.n - 1] + own[self.n - 1]) if self.n else 0
            old = getattr(self, pool)
            if first + len(add) > len(old):
                old = np.concatenate([old, np.zeros(max(len(add), len(old)), dtype)])
                setattr(self, pool, old)
            old[first : first + len(add)] = add
            own[at] = np.array([len(x) for x in items], np.int64) // old.itemsize
            begin[at] = first + np.cumsum(own[at]) - own[at]
        return at

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & U64(self.SLOTS - 1)).astype(np.int64)
        while len(slot):
            free = self.table[slot] < 0
            self.table[slot[free]] = entry[free]
            left = self.table[slot] != entry
            slot, entry = (slot[left] + 1) & (self.SLOTS - 1), entry[left]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry with each hash, or -1."""
        slot = (h & U64(self.SLOTS - 1)).astype(np.int64)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)
            out[todo] = self.table[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.hashes[out[todo]] != h[todo])]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw, off, m = data.tobytes(), offsets.tolist(), len(offsets) - 1
        whole = uncut(data, offsets) | (not self.cuts)
        if any(x in raw for x in self.special):
            whole |= np.array([any(x in raw[a:z] for x in self.special) for a, z in zip(off, off[1:], strict=False)], bool)
        out: list[bytes] = [b""] * m
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._ids([raw[off[i] : off[i + 1]]])[0]
        # units: what stands between spaces, of the texts that are cut
        blank = np.flatnonzero(data == 0x20)
        starts, ends = np.concatenate([offsets[:-1], blank + 1]), np.concatenate([offsets[1:], blank])
        starts.sort(), ends.sort()
        row = np.searchsorted(offsets, starts, "right") - 1
        row[starts == len(data)] = m - 1
        full = ends > starts  # an empty text; in others no unit of a cut text is empty
        starts, ends, row = starts[full], ends[full], row[full]
        cut = ~whole[row]
        starts, ends, row = starts[cut], ends[cut], row[cut]
        if not len(starts):
            return out
        head = starts == offsets[row]
        p, q = powers(len(data))
        with np.errstate(over="ignore"):
            acc = np.zeros(len(data) + 1, U64)
            np.cumsum(BYTE_CODE[data] * p, out=acc[1:])
            h = mix64((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93) + head.astype(U64) * U64(0xA24BAED4963EE407))
        entry, size = self._find(h), ends - starts
        known = np.flatnonzero(entry >= 0)
        if len(known):  # equal hashes are compared byte by byte
            n = size[known]
            same_size = self.unit_len[entry[known]] == n
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(starts[known], n) + inside] != self.bytes[np.minimum(np.repeat(self.unit_at[entry[known]], n) + inside, len(self.bytes) - 1)]
            bad = ~same_size | (np.add.reduceat(differ, np.cumsum(n) - n) > 0)
            entry[known[bad]] = -1
        missing = np.flatnonzero(entry < 0)
        kept = self.n
        if len(missing):
            asked = [(raw[a:z], x) for a, z, x in zip(starts[missing].tolist(), ends[missing].tolist(), head[missing].tolist(), strict=True)]
            new = list(dict.fromkeys(asked))
            later = self._learn({u for u, x in new if not x})
            first = [u for u, x in new if x]
            begin = dict(zip(first, self._ids(first), strict=True)) if first else {}
            if self.n > self.MEMO and len(missing) > (1 - self.STALE) * len(starts):
                self._forget()
                kept, entry[:] = 0, -1
                # what the old memo had is asked for again in this one slice
                missing = np.arange(len(starts))
                asked = [(raw[a:z], x) for a, z, x in zip(starts.tolist(), ends.tolist(), head.tolist(), strict=True)]
                new = list(dict.fromkeys(asked))
                later = self._learn({u for u, x in new if not x})
                first = [u for u, x in new if x]
                begin = dict(zip(first, self._ids(first), strict=True)) if first else {}
            new.sort(key=lambda k: len(k[0]) > self.LONGEST)  # long ones behind, where they are not kept
            numbers = self._grow(new, [begin[u] if x else later[u] for u, x in new])
            place = dict(zip(new, numbers.tolist(), strict=True))
            entry[missing] = [place[k] for k in asked]
            if kept <= self.MEMO:
                short = sum(len(u) <= self.LONGEST for u, _ in new)
                one = np.unique(entry[missing], return_index=True)
                where = one[0] < kept + short
                if kept + short > len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros(max(short, len(self.hashes)), U64)])
                self.hashes[one[0][where]] = h[missing[one[1][where]]]
                self._insert(h[missing[one[1][where]]], one[0][where])
                kept += short
        n = self.ids_len[entry]
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.ids_at[entry] - before, n) + np.arange(n.sum())]
        total = np.bincount(row, n, minlength=m).astype(np.int64)
        upto = np.cumsum(total) * ids.itemsize
        made = ids.tobytes()
        for i, (z, k) in enumerate(zip(upto.tolist(), (total * ids.itemsize).tolist(), strict=True)):
            if k:
                out[i] = made[z - k : z]
        self.n = kept
        return out

    def _forget(self) -> None:
        self.n, self.table = 0, np.full(self.SLOTS, -1, np.int64)
        self.hashes, self.bytes, self.ids = np.zeros(1 << 16, U64), np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, self.dtype)
        self.unit_at, self.unit_len, self.ids_at, self.ids_len = (np.zeros(1 << 16, np.int64) for _ in range(4))


_LOADED: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _LOADED:
        _LOADED[path] = UnitEncoder(path)
    return _LOADED[path]


# ---------------------------------------------------------------- writing and reading


def _write_shards(path: str, tokenizer: str, end_id: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, seq = TaskContext.get().partitionId(), encoder(tokenizer), 0
        end = np.array([end_id], enc.dtype).tobytes()

        def slices():
            for b in batches:
                view, names = TextView(b.column("text")), b.column("doc_id").cast(pa.int64()).to_pylist()
                for i, j, data, off in view.slices(min(CODE_BYTES, shard_bytes)):
                    yield names[i:j], data, off

        source = slices()
        piece = next(source, None)
        gc.disable()  # millions of short-lived lists and no cycles
        try:
            while piece is not None:  # a file each round
                shard, ids, offs, sizes, at = f"{task:05d}-{seq:04d}", [], [], [], 0
                seq += 1

                def write(out):
                    nonlocal piece, at
                    while piece is not None and at < shard_bytes:
                        names, data, off = piece
                        coded = enc.encode(data, off)
                        heads = [(NO_ID if d is None else d).to_bytes(8, "little", signed=True) + bytes([enc.width, d is None]) + bytes(6) for d in names]
                        for d, x, record in zip(names, coded, frames([h + x + end for h, x in zip(heads, coded, strict=True)]), strict=True):
                            out.write(record)
                            ids.append(NO_ID if d is None else d), offs.append(at), sizes.append(len(x) // enc.width + 1)
                            at += len(record)
                        piece = next(source, None)

                put_file(f"{path}/part-{shard}.tfr", write)
                index = np.r_[len(ids), ids, offs, sizes].astype("<i8")
                put_file(f"{path}/part-{shard}.idx", lambda out, index=index: out.write(index.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["shard", "records", "ids"])
        finally:
            gc.enable()

    return rows


def below(cuts: list[int], key: Column, or_equal: bool = False) -> Column:
    """How many of the ascending ``cuts`` lie below ``key`` (or at it), by bisection: a number of steps with the logarithm of their number."""
    if not cuts:
        return F.lit(0)
    found = F.split(F.lit(",".join(str(int(x)) for x in cuts)), ",").cast("array<long>")  # a constant
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, wide: Column) -> Column:
        cut = F.get(found, at + wide - 1)  # null behind the end
        return F.when((cut <= key) if or_equal else (cut < key), at + wide).otherwise(at)

    return F.reduce(steps, F.lit(0), step)


def write_records(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, tasks: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``path``; returns the manifest: shard, records, ids, start (global)."""
    docs = plain(docs, "doc_id", "text")
    tasks = tasks or partitions_for(spark, docs)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    cuts = docs.select(F.percentile_approx(key, [i / tasks for i in range(1, tasks)] or [0.5], max(10_000, 4 * tasks)).alias("q")).first()["q"] or []
    # a doc_id that fills k ranges is dealt over them by a hash of the text, by which its rows are in order
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    first = below(cuts, key)
    part = first + F.floor(share * (below(cuts, key, or_equal=True) - first) / (1 << 20))
    placed = docs.withColumn("_share", share).withColumn("_part", F.least(part, F.lit(tasks - 1)).cast("int"))
    sorted_ = placed.repartitionById(tasks, F.col("_part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "_share", F.asc_nulls_first("text")).select("doc_id", "text")
    done = sorted_.mapInArrow(tidy(_write_shards(path, tokenizer, end_id, shard_bytes)), "shard string, records long, ids long").collect()  # a row a file of shard_bytes
    rows, start = [], 0
    for r in sorted(done, key=lambda r: [int(x) for x in r["shard"].split("-")]):
        rows.append((r["shard"], r["records"], r["ids"], start))
        start += r["ids"]
    return spark.createDataFrame(rows, "shard string, records long, ids long, start long")


def read_index(path: str, shard: str) -> np.ndarray:
    """doc_ids, byte offsets and numbers of ids of a shard's records."""
    a = np.frombuffer(get_file(f"{path}/part-{shard}.idx"), "<i8")
    return a[1:].reshape(3, int(a[0]))


def read_ids(path: str, shard: str, index_rows: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records of a shard, in file order or as the given rows of its index ask for them.

    Only byte ranges are read: runs of neighbouring records of at most ``READ_BYTES`` (or one longer record) at once.
    """
    fs, name = filesystem(f"{path}/part-{shard}.tfr")
    with fs.open_input_file(name) as f:
        offs = read_index(path, shard)[1]
        ends = np.r_[offs[1:], f.size()]
        wanted = np.arange(len(offs)) if index_rows is None else np.asarray(index_rows, np.int64)
        at = 0
        while at < len(wanted):
            to, first = at + 1, int(offs[wanted[at]])
            while to < len(wanted) and wanted[to] == wanted[to - 1] + 1 and ends[wanted[to]] - first <= READ_BYTES:
                to += 1
            some = wanted[at:to]
            buf = memoryview(f.read_at(int(ends[some[-1]]) - first, first))
            for p in unframe(buf, (offs[some] - first).tolist()):
                yield None if p[9] else int.from_bytes(p[:8], "little", signed=True), np.frombuffer(p[16:], "<u2" if p[8] == 2 else "<u4")
            at = to


def read_records(spark: SparkSession, manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record, from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out):
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(list(cols[4]), pa.list_(pa.int64()))] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist(), strict=True):
                out = []
                for d, ids in read_ids(path, shard):
                    out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int64) if with_ids else None))
                    start += len(ids)
                    if len(out) >= (200 if with_ids else 5000):
                        yield batch(out)
                        out = []
                yield batch(out)

    some = manifest.where("records > 0")
    return some.repartition(max(1, manifest.count()), "shard").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def encode_to_records(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32."""
    ws = Workspace(spark, "records")
    return read_records(spark, write_records(spark, docs, ws.path, tokenizer, end_id), ws.path)
