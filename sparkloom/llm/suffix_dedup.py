"""Exact substring deduplication over range-partitioned, locally sorted suffixes.

A byte goes when it lies in a ``length``-byte string (50) that also starts in a document with a smaller doc_id.

Sparse suffixes. Of every ``length``-byte string the position with the smallest hash of its 16-byte gram is selected, a choice
that depends on the string alone. So wherever the string occurs, the suffix at that position is selected too, and only
about one suffix in 18 needs to be compared. The strings that select a position start some ``low`` to ``high`` bytes before it. Those that
start at most ``(length - 16) // 2`` (17) bytes before it all hold the 33 bytes from the gram on, the others the 34 bytes that end with
it: these are the *cores* of the suffix. Strings can only be equal where a core is. A core of 33 bytes that two documents share is nearly always
part of a longer match, however large the table; a gram of 16 bytes soon is not.

1. *Blocks.* Each scan task writes its texts to a block file on shared storage (Arrow, zstd), its selected suffixes beside it, and sends the
   distinct hashes of their cores, by hash range, with the number of different surroundings. Texts are not shuffled. A core that millions of
   documents share is sent once a block.
2. *Shared cores.* A range owner tells each block which of its cores occur in another document, and which have more than
   ``HOT_CONTEXTS`` surroundings in all.
3. *Contexts.* Blocks send what the strings around a shared core cover (up to 50 bytes from the gram on, 34 before it) with the smallest
   doc_id of the block that has this context, once for each distinct context. Splitters sampled from the shared cores range-partition
   them by leading bytes; a splitter never separates suffixes with equal cores, so nothing can match across a boundary.
   Of a core with very many surroundings the up to 18 whole strings around it are sent instead, by their hashes, so such a core is
   spread over all tasks; one string costs its task a row a block.
4. *Buckets* sort their suffixes by multikey quicksort (on 8-byte words; ties go on to the next word) and what stands before
   them likewise, compare neighbours, and so know for each string position around a gram which contexts agree there
   and the smallest doc_id among them: the owner. Only owners smaller than the context's own document are told to the blocks.
5. Blocks mark the covered bytes and give the results.

Hashes only select candidates; matches are decided on bytes. Memory: a block (``BLOCK_BYTES`` of text, or one longer document) or a
bucket at a time. Input whose order could change between attempts (it comes from a shuffle) is written down first.

Null and empty texts have no strings. A null doc_id counts as large as the largest possible one. Rows that repeat a doc_id do not remove one
another's bytes. Of equal texts the smallest doc_id keeps its bytes. Empty table: no rows. Extra columns, also such whose names differ
only in case, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import BYTE_CODE, U64, TextView, Workspace, get_file, mix64, partitions_for, plain, put_file, settled, smallest_hashes, tidy

GRAM, BLOCK_BYTES, SLICE, LAST_ID = 16, 8 << 20, 1 << 18, (1 << 63) - 1
HOT_CONTEXTS = 100_000
#: What a range of suffixes may hold; the number of ranges, and of the samples that place them, follows from it.
BUCKET_BYTES = 32 << 20
#: Cores are known by 48 bits: more than one in 10,000 that stands in one document only is taken for shared above some 3 * 10^10 cores.
CORE_BITS = U64(48)
_CODEC = "zstd"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each position on (by doubling)."""
    with np.errstate(over="ignore"):
        h, step, mult = BYTE_CODE[data], 1, 0x9E3779B97F4A7C15
        while step < GRAM:
            h = h[: len(h) - step] * U64(mult) + h[step:]
            step, mult = step * 2, mult * mult * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        return mix64(h) | U64(1)  # never 0


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        a = f(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return f(a[:-rest], a[rest:]) if rest else a


def selected(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, low, high, hashes of all grams) of the selected suffixes: the ``length``-byte strings inside one document of which one is
    the smallest start ``low`` to ``high`` bytes before it."""
    n, before = len(data), length - GRAM
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, U64)
    h = gram_hashes(data)
    smallest, size = _sliding(h, before + 1, np.minimum), np.diff(offsets)
    whole = np.repeat(np.tile([True, False], len(size)), np.stack([np.maximum(size - length + 1, 0), np.minimum(size, length - 1)], axis=1).ravel())
    smallest *= whole[: len(smallest)]  # 0 where no string inside one document starts
    reach = np.zeros(len(h) + before, U64)
    reach[before : before + len(smallest)] = smallest
    most = _sliding(reach, before + 1, np.maximum)[: len(h)]  # largest of the minima of the strings that contain a position
    at = np.flatnonzero((h == most) & (most > 0))
    # the strings that select a position follow one another: they are part of a run of equal minima
    begin = np.flatnonzero(np.r_[True, smallest[1:] != smallest[:-1]])
    value, end = smallest[begin], np.r_[begin[1:], len(smallest)] - 1
    run, later = np.searchsorted(begin, at, "right") - 1, np.arange(len(at))
    while len(later := later[value[run[later]] != h[at[later]]]):
        run[later] -= 1
    low, high = at - np.minimum(end[run], at), at - np.maximum(begin[run], at - before)
    return at, low.astype(np.uint8), high.astype(np.uint8), h


class Side(NamedTuple):
    """Strings that start ``first`` to ``last`` bytes before a gram, and the core that all of them hold: ``size`` bytes from ``start`` on."""

    first: int
    last: int
    start: int
    size: int


def sides(length: int) -> tuple[Side, Side]:
    before, middle = length - GRAM, (length - GRAM) // 2
    return Side(0, middle, 0, length - middle), Side(middle + 1, before, -middle - 1, GRAM + middle + 1)


def cores(at: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each side (which suffixes have strings there, hashes of their cores, hashes of what these strings cover around the core)."""
    with np.errstate(over="ignore"):
        for number, side in enumerate(sides(length)):
            which = np.flatnonzero((low <= side.last) & (high >= side.first))
            p, end = at[which], side.start + side.size
            left, right = np.minimum(high[which], side.last).astype(np.int64), length - np.maximum(low[which], side.first).astype(np.int64)
            key, around = np.full(len(which), number, U64), (left * 256 + right).astype(U64)
            for step in [*range(side.start, end - GRAM, GRAM), end - GRAM]:
                key = mix64(key * U64(0x9E3779B97F4A7C15) + h[p + step])
            for step in range(0, side.last + side.start, GRAM):
                around = mix64(around * U64(0x9E3779B97F4A7C15) + h[p - np.maximum(left - step, -side.start)])
            for step in range(0, length - side.first - end, GRAM):
                around = mix64(around * U64(0x9E3779B97F4A7C15) + h[p + np.maximum(right - step, end) - GRAM])
            yield which, np.maximum(key >> (U64(64) - CORE_BITS), U64(1)) << (U64(64) - CORE_BITS), around  # never 0


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows by multikey quicksort on 8-byte words: ties go on to the next word."""
    n, w = rows.shape
    padded = np.zeros((n, -(-w // 8) * 8), np.uint8)
    padded[:, :w] = rows
    words = padded.view(">u8").astype(U64)
    order = np.argsort(words[:, 0], kind="stable")
    if n < 2:
        return order
    first = words[order, 0]
    group = np.r_[0, np.cumsum(first[1:] != first[:-1])]
    for k in range(1, words.shape[1]):
        tied = np.r_[False, group[1:] == group[:-1]]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        sub = order[at]
        sub = sub[np.lexsort((words[sub, k], group[at]))]
        order[at] = sub
        new = np.zeros(n, bool)
        new[1:] = group[1:] != group[:-1]
        word = words[sub, k]
        split = np.r_[False, word[1:] != word[:-1]]
        new[at] |= split & (np.r_[0, np.diff(at)] == 1)
        group = np.cumsum(new)
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before; -1 for the first."""
    out = np.full(len(order), -1, np.int16)
    for at in range(1, len(order), 100_000):
        to = min(len(order), at + 100_000)
        differ = rows[order[at:to]] != rows[order[at - 1 : to - 1]]
        out[at:to] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


# ---------------------------------------------------------------- block files


def _block_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])


def _read_block(path: str, block: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, the same with a number for null, data, offsets) of each slice."""
    with pa.ipc.open_file(pa.BufferReader(get_file(f"{path}/block-{block}.arrow"))) as f:
        for i in range(f.num_record_batches):
            b = f.get_batch(i)
            view = TextView(b.column("text"))
            ids = b.column("doc_id")
            yield ids, ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False), view.data, view.offsets


def _pack(**arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    columns = [pa.array([np.ascontiguousarray(a).tobytes()], pa.large_binary()) for a in arrays.values()]
    batch = pa.RecordBatch.from_arrays(columns, names=[f"{k}:{a.dtype.str}" for k, a in arrays.items()])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    b = next(iter(pa.ipc.open_stream(pa.py_buffer(blob) if isinstance(blob, bytes) else blob)))
    return {n.split(":")[0]: np.frombuffer(b.column(i)[0].as_buffer(), n.split(":")[1]) for i, n in enumerate(b.schema.names)}


def _rows(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


_MESSAGE = (["part", "block", "kind", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])
_REPLY = (["block", "kind", "blob"], [pa.int64(), pa.int32(), pa.binary()])
_MESSAGE_SQL, _REPLY_SQL = "part int, block long, kind int, blob binary", "block long, kind int, blob binary"
CORES, SAMPLE, OWNERS, PRESENT, STRINGS, TOTALS, HOT = range(7)
#: Cores that a slice samples at most, and cores in a row of samples.
SAMPLED = 16


def _split(keys: np.ndarray, parts: int) -> np.ndarray:
    """First index of each part's range in sorted hashes, with the end."""
    part = (keys >> U64(32)) * U64(parts) >> U64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=U64))


def _block_cores(key: np.ndarray, around: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct cores, sorted, what is known of each, and the number in that order of every given core. The last bit of what is known says
    that several documents have the core, the others are the binary digits of its number of different surroundings."""
    order = np.argsort(key)
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]][: len(k)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(k)])
    number = np.empty(len(k), np.uint32)
    number[order] = np.cumsum(new) - 1
    count, several = np.ones(len(first)), np.zeros(len(first), bool)
    repeated = np.flatnonzero(size > 1)
    if len(repeated):
        at = order[np.repeat(size > 1, size)]
        at = at[np.lexsort((around[at], key[at]))]
        k, around, row = key[at], around[at], row[at]
        new = np.r_[True, k[1:] != k[:-1]]
        other = np.cumsum(new | np.r_[True, around[1:] != around[:-1]])
        begin = np.flatnonzero(new)
        count[repeated] = np.r_[other[begin[1:] - 1], other[-1]] - other[begin] + 1
        several[repeated] = np.minimum.reduceat(row, begin) != np.maximum.reduceat(row, begin)
    return key[order[first]], (np.frexp(count)[1] << 1 | several).astype(np.uint8), number


def _sorted_out(key: np.ndarray, known: np.ndarray) -> bytes:
    """Sorted cores as differences, their first bytes, then their second bytes and so on, because the upper ones are mostly 0."""
    step = np.diff(key >> (U64(64) - CORE_BITS), prepend=U64(0))
    return known.tobytes() + step.view(np.uint8).reshape(-1, 8).T.tobytes()


def _sorted_in(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8).reshape(9, -1)
    return np.cumsum(np.ascontiguousarray(raw[1:].T).view(U64).ravel(), dtype=U64) << (U64(64) - CORE_BITS), raw[0]


def _write_blocks(path: str, length: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, source, left = TaskContext.get().partitionId(), iter(batches), []

        def slices():
            for b in source:
                view = TextView(b.column("text"))
                ids = b.column("doc_id").cast(pa.int64())
                for i, j, data, off in view.slices(SLICE):
                    yield ids.slice(i, j - i), data, off

        pieces, seq, wide = slices(), 0, max(s.size for s in sides(length))
        while (head := next(pieces, None)) is not None:
            block, found, sample, upto, base, size = (pid << 24) + seq, [], [], [], 0, 0
            seq += 1

            def write(out):
                nonlocal base, size
                with pa.ipc.new_file(out, _block_schema(), options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
                    piece, suffixes = head, 0
                    while piece is not None:
                        ids, data, off = piece
                        w.write_batch(pa.RecordBatch.from_arrays([ids, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])], schema=_block_schema()))
                        at, low, high, h = selected(data, off, length)
                        row = np.searchsorted(off, at, "right") + base
                        key, around = np.zeros((2, len(at)), U64), np.zeros((2, len(at)), U64)
                        for k, (side, (which, core, near)) in enumerate(zip(sides(length), cores(at, low, high, h, length), strict=True)):
                            key[k, which], around[k, which] = core, near
                            pick = which[np.arange(min(len(which), SAMPLED // 2)) * len(which) // max(1, min(len(which), SAMPLED // 2))]
                            text = np.zeros((len(pick), wide), np.uint8)
                            text[:, : side.size] = data[at[pick][:, None] + np.arange(side.start, side.start + side.size)]
                            sample.append((key[k, pick], text))
                        found.append((at, low, high, row, key, around))
                        suffixes, base, size = suffixes + len(at), base + len(ids), size + len(data)
                        upto.append(suffixes)
                        if size >= BLOCK_BYTES:
                            break
                        piece = next(pieces, None)

            put_file(f"{path}/block-{block}.arrow", write)
            at, low, high, row, key, around = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
            found.clear()
            core = np.full(key.shape, 0, np.uint32)
            g, known, core[key > 0] = _block_cores(key[key > 0], around[key > 0], np.stack([row, row])[key > 0])
            core[key == 0] = len(g)
            put_file(f"{path}/suffixes-{block}.bin", lambda out, a=(at, low, high, core, upto, g): out.write(_pack(step=np.diff(a[0].astype(np.uint32), prepend=np.uint32(0)), low=a[1], high=a[2], near=a[3][0], far=a[3][1], upto=np.array(a[4]), cores=np.array([len(a[5])]))))
            cut = _split(g, parts)
            picked, texts = (np.concatenate(x) for x in zip(*sample, strict=True))
            home = ((picked >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            out = [(q, block, CORES, int(cut[q]).to_bytes(8, "little") + _sorted_out(g[cut[q] : cut[q + 1]], known[cut[q] : cut[q + 1]])) for q in range(parts) if cut[q] < cut[q + 1]]
            for q in np.unique(home).tolist():
                out.append((q, block, SAMPLE, int((home == q).sum()).to_bytes(8, "little") + picked[home == q].tobytes() + texts[home == q].tobytes()))
            yield _rows([*out, (block % parts, block, PRESENT, b"")], *_MESSAGE)

    return rows


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, blobs, base, samples, passed = [], [], [], [], []
    for b in batches:
        for block, kind, blob in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "blob")), strict=True):
            if kind == CORES:
                blocks.append(block)
                base.append(int.from_bytes(blob[:8], "little"))
                blobs.append(_sorted_in(blob[8:]))
            elif kind == SAMPLE:
                samples.append(blob)
            else:
                passed.append((block, kind, blob))
    yield _rows(passed, *_REPLY)
    if blobs:
        cut = np.r_[0, np.cumsum([len(x) for x, _ in blobs])]
        g, known = (np.concatenate(x) for x in zip(*blobs, strict=True))
        blobs.clear()
        order = np.argsort(g)
        g, known = g[order], known[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        shared = (size > 1) | (np.bitwise_or.reduceat(known, first) & 1 > 0)
        total = np.add.reduceat(1 << (known >> 1).astype(np.int64), first)
        hot = shared & (total > HOT_CONTEXTS)
        yield _rows([(-1, TOTALS, np.array([total[shared & ~hot].sum(), total[hot].sum()], np.int64).tobytes())], *_REPLY)
        yield _rows([(-1, SAMPLE, x) for x in _shared_samples(samples, g[first[shared & ~hot]])], *_REPLY)
        for kind, which in ((CORES, shared), (HOT, hot)):
            told = np.zeros(len(g), bool)  # as they came
            told[order] = np.repeat(which, size)
            for at in range(0, len(blocks), 200):
                yield _rows([(blocks[k], kind, base[k].to_bytes(8, "little") + np.packbits(told[cut[k] : cut[k + 1]]).tobytes()) for k in range(at, min(at + 200, len(blocks))) if told[cut[k] : cut[k + 1]].any()], *_REPLY)


def _shared_samples(samples: list[bytes], shared: np.ndarray) -> Iterator[bytes]:
    """The sampled cores that are among those shared (sorted), ``SAMPLED`` in a blob."""
    texts = []
    for blob in samples if len(shared) else []:
        n = int.from_bytes(blob[:8], "little")
        key, text = np.frombuffer(blob, U64, n, 8), np.frombuffer(blob, np.uint8, offset=8 + 8 * n).reshape(n, -1)
        texts += [x.tobytes() for x in text[shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key]]
    for k in range(0, len(texts), SAMPLED):
        yield b"".join(texts[k : k + SAMPLED])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows come sorted by block."""
    block, got = None, []
    for b in batches:
        for k, kind, blob in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "blob")), strict=True):
            if k != block:
                if got:
                    yield block, got
                block, got = k, []
            got.append((kind, blob))
    if got:
        yield block, got


def _send_contexts(path: str, length: int, splitters: list[bytes], buckets: int):
    before, parts, wide = length - GRAM, max(buckets, len(splitters) + 1), max(s.size for s in sides(length))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splitters, f"S{wide}")
        for block, got in _by_block(batches):
            s = _unpack(get_file(f"{path}/suffixes-{block}.bin"))
            state = np.zeros(s["cores"][0] + 8, np.uint8)  # of each core, and of none: 1 shared, 2 shared with very many surroundings
            for kind, blob in got:
                if kind in (CORES, HOT):
                    first, told = int.from_bytes(blob[:8], "little"), np.unpackbits(np.frombuffer(blob, np.uint8, offset=8))
                    state[first : first + len(told)] += told
            place, begin = np.cumsum(s["step"], dtype=np.uint32), np.r_[0, s["upto"]]
            side, upto = [], []
            for i, (_, ids, data, off) in enumerate(_read_block(path, block)):
                padded = np.r_[np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)]
                span, found = slice(begin[i], begin[i + 1]), []
                for half, core in zip(sides(length), (s["near"][span], s["far"][span]), strict=True):
                    k = np.flatnonzero(state[core])
                    at = place[span][k].astype(np.int64)
                    left = np.minimum(s["high"][span][k], half.last)
                    right = (length - np.maximum(s["low"][span][k], half.first).astype(np.int64)).astype(np.uint8)
                    ctx = padded[at[:, None] + np.arange(before + length)]
                    text = np.zeros((len(k), wide), np.uint8)
                    text[:, : half.size] = ctx[:, before + half.start : before + half.start + half.size]
                    ctx[~_inside(left, right, length)] = 0
                    found.append((at, left, right, ctx, ids[np.searchsorted(off, at, "right") - 1], state[core[k]] > 1, text))
                side.append([np.concatenate(x) for x in zip(*found, strict=True)])
                upto.append(len(side[-1][0]))
            at, left, right, ctx, doc, hot, core = (np.concatenate(x) for x in zip(*side, strict=True))
            side.clear()
            order, first = equal_rows(ctx, left, right)
            rep = order[first]
            part = np.where(hot[rep], parts, np.searchsorted(cuts, core[rep].view(f"S{wide}").ravel(), "right")) if len(rep) else np.zeros(0, np.int64)
            by = np.lexsort((core[rep, :8].copy().view(">u8")[:, 0], part)) if len(rep) else part
            rank, number = np.empty(len(rep), np.int64), np.empty(len(at), np.int64)
            rank[by] = np.arange(len(rep))
            number[order] = np.repeat(rank, np.diff(np.r_[first, len(at)]))
            least = np.minimum.reduceat(doc[order], first)[by] if len(rep) else np.zeros(0, np.int64)
            rep, cut = rep[by], np.searchsorted(part[by], np.arange(parts + 1))
            put_file(f"{path}/side-{block}.bin", lambda out, a=(at, left, right, number, least, upto): out.write(_pack(step=np.diff(a[0].astype(np.uint32), prepend=np.uint32(0)), left=a[1], right=a[2], number=a[3].astype(np.uint32), least=a[4].astype(np.int64), upto=np.cumsum(a[5]))))
            out = []
            for q in np.flatnonzero(np.diff(cut)).tolist():
                k = rep[cut[q] : cut[q + 1]]
                out.append((q, block, OWNERS, _pack(text=ctx[k][_inside(left[k], right[k], length)], left=left[k], right=right[k], doc=least[cut[q] : cut[q + 1]].astype(np.int64), number=cut[q : q + 1].astype(np.uint32))))
            k = rep[cut[parts] :]
            strings = _strings(ctx[k], left[k], right[k], np.arange(cut[parts], len(rep)), length)
            for text, shift, which in strings:
                home = (mix64(text.view(U64).reshape(len(text), -1).sum(axis=1, dtype=U64)) % U64(parts)).astype(np.int64)
                for q in np.unique(home).tolist():
                    k = np.flatnonzero(home == q)
                    out.append((q, block, STRINGS, _pack(text=text[k], shift=np.full(len(k), shift, np.uint8), doc=least[which[k]].astype(np.int64), number=which[k].astype(np.uint32))))
            yield _rows([*out, (block % parts, block, PRESENT, b"")], *_MESSAGE)

    return rows


def _inside(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a context count: ``left`` before its gram, ``right`` from it on."""
    place = np.arange(length - GRAM + length) - (length - GRAM)
    return (place >= -left.astype(np.int64)[:, None]) & (place < right[:, None])


def _strings(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, number: np.ndarray, length: int):
    """(strings padded to whole words, shift, contexts) of each place of the gram: cores with very many surroundings go by their strings."""
    before, wide = length - GRAM, -(-length // 8) * 8
    for shift in range(before + 1 if len(number) else 0):
        k = np.flatnonzero((left >= shift) & (right >= length - shift))
        if len(k):
            text = np.zeros((len(k), wide), np.uint8)
            text[:, :length] = ctx[k, before - shift : before - shift + length]
            yield text, shift, number[k]


def string_owners(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, owner) of the strings that occur in a smaller document."""
    order = multikey_order(text)
    first = np.flatnonzero(common_prefix(text, order) < text.shape[1])
    owner = np.empty(len(doc), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(doc)]))
    rows = np.flatnonzero(owner < doc)
    return rows, owner[rows]


def row_hashes(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), U64)
    with np.errstate(over="ignore"):
        for w in padded.view(U64).T:
            h = mix64(h * U64(0x9E3779B97F4A7C15) + w)
    return h


def equal_rows(ctx: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal contexts stand together, where each distinct one begins there)."""
    whole = np.concatenate([ctx, left[:, None], right[:, None]], axis=1)
    order = np.argsort(row_hashes(whole), kind="stable")
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 100_000):
        to = min(len(order), at + 100_000)
        same[at:to] = (whole[order[at:to]] == whole[order[at - 1 : to - 1]]).all(axis=1)  # equal bytes; a collision of hashes only leaves a context twice
    return order, np.flatnonzero(~same)


def bucket_owners(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (context, first shift, last shift, owner): strings that start ``shift`` bytes before the gram and occur in a smaller document."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    before, (order, first) = length - GRAM, equal_rows(ctx, left, right)
    each, rep = np.diff(np.r_[first, len(doc)]), order[first]
    least, largest = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    core = row_hashes(ctx[rep, before + side.start : before + side.start + side.size])
    by = np.argsort(core)
    start = np.flatnonzero(np.r_[True, core[by[1:]] != core[by[:-1]]])
    size = np.diff(np.r_[start, len(by)])
    alone = by[start[size == 1]]  # nothing else has the core, so all strings have one owner
    alone = alone[least[alone] < largest[alone]]
    runs = [(alone, length - right[rep[alone]].astype(np.int64), left[rep[alone]].astype(np.int64), least[alone])]
    rest = by[np.repeat(size > 1, size)]
    runs += [(rest[who], lo, hi, owner) for who, lo, hi, owner in _compared(ctx[rep[rest]], left[rep[rest]], right[rep[rest]], least[rest], largest[rest], length, side)]
    who, lo, hi, owner = (np.concatenate(x) for x in zip(*runs, strict=True))
    n = each[who]
    row = order[np.repeat(first[who] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(who) else who
    lo, hi, owner = (np.repeat(x, n) for x in (lo, hi, owner))
    keep = owner < doc[row]
    return row[keep], lo[keep], hi[keep], owner[keep]


def _compared(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, largest: np.ndarray, length: int, side: Side) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of different contexts, by sorting their suffixes and what stands before these; each has documents from ``least`` to ``largest``."""
    n, before = len(least), length - GRAM
    if n < 2:
        return []
    after, ahead = ctx[:, before : before + length - side.first], ctx[:, before - side.last : before][:, ::-1]
    order_r, order_l = multikey_order(after), multikey_order(ahead)
    pre_r, pre_l = common_prefix(after, order_r), common_prefix(ahead, order_l)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    now, since, runs = np.full(n, LAST_ID), np.zeros(n, np.int64), []

    def flush(who, to):
        if len(who):
            runs.append((who, since[who], np.full(len(who), to), now[who]))

    for shift in range(side.first, side.last + 1):
        class_r[order_r] = np.cumsum(pre_r < length - shift)
        class_l[order_l] = np.cumsum(pre_l < shift)
        fits = np.flatnonzero((left >= shift) & (right >= length - shift))
        found = np.full(n, LAST_ID)
        if len(fits):
            key = class_r[fits] * (n + 1) + class_l[fits]
            by = np.argsort(key)
            ks = key[by]
            first = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
            owner = np.repeat(np.minimum.reduceat(least[fits[by]], first), np.diff(np.r_[first, len(ks)]))
            smaller = owner < largest[fits[by]]
            found[fits[by[smaller]]] = owner[smaller]
        changed = np.flatnonzero(found != now)
        flush(changed[now[changed] != LAST_ID], shift - 1)
        now[changed], since[changed] = found[changed], shift
    flush(np.flatnonzero(now != LAST_ID), side.last)
    return runs


def _owners(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, parts, passed, spread = [], [], [], []
        for b in batches:
            for block, kind, blob in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "blob")), strict=True):
                if kind == OWNERS:
                    blocks.append(block)
                    parts.append(_unpack(blob))
                elif kind == STRINGS:
                    spread.append((block, _unpack(blob)))
                else:
                    passed.append((block, kind, blob))
        yield _rows(passed, *_REPLY)
        if spread:
            text, doc, shift, number = (np.concatenate([p[c] for _, p in spread]) for c in ("text", "doc", "shift", "number"))
            who = np.repeat([k for k, _ in spread], [len(p["doc"]) for _, p in spread])
            rec, owner = string_owners(text.reshape(len(doc), -1), doc)
            for block in np.unique(who[rec]).tolist():
                x = np.flatnonzero(who[rec] == block)
                yield _rows([(block, OWNERS, _pack(number=number[rec[x]], lo=shift[rec[x]], hi=shift[rec[x]], owner=owner[x]))], *_REPLY)
        if parts:
            text, left, right, doc = (np.concatenate([p[c] for p in parts]) for c in ("text", "left", "right", "doc"))
            number = np.concatenate([p["number"][0] + np.arange(len(p["doc"])) for p in parts])
            who, (near, far) = np.repeat(np.arange(len(parts)), [len(p["doc"]) for p in parts]), sides(length)
            ctx = np.zeros((len(doc), length - GRAM + length), np.uint8)
            ctx[_inside(left, right, length)] = text
            parts = [None] * len(parts)
            found = []
            for side, k in ((near, np.flatnonzero(right >= near.size)), (far, np.flatnonzero(right < near.size))):
                rec, *run = bucket_owners(ctx[k], left[k], right[k], doc[k], length, side)
                found.append((k[rec], *run))
            rec, lo, hi, owner = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(who[rec], kind="stable")
            cut = np.searchsorted(who[rec][by], np.arange(len(parts) + 1))
            for at in range(0, len(parts), 200):
                out = []
                for k in range(at, min(at + 200, len(parts))):
                    x = by[cut[k] : cut[k + 1]]
                    if len(x):
                        out.append((blocks[k], OWNERS, _pack(number=number[rec[x]].astype(np.uint32), lo=lo[x].astype(np.uint8), hi=hi[x].astype(np.uint8), owner=owner[x].astype(np.int64))))
                yield _rows(out, *_REPLY)

    return rows


def _results(path: str, length: int):
    before = length - GRAM

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in _by_block(batches):
            runs = [_unpack(x) for kind, x in got if kind == OWNERS]
            number, lo, hi, owner = (np.concatenate([np.zeros(0, t), *[r[c] for r in runs]]).astype(np.int64) for c, t in (("number", np.uint32), ("lo", np.uint8), ("hi", np.uint8), ("owner", np.int64)))
            by = np.argsort(number, kind="stable")
            number, lo, hi, owner = number[by], lo[by], hi[by], owner[by]
            s = _unpack(get_file(f"{path}/side-{block}.bin"))
            place, begin = np.cumsum(s["step"], dtype=np.uint32), np.r_[0, s["upto"]]
            for i, (named, ids, data, off) in enumerate(_read_block(path, block)):
                a, z = begin[i], begin[i + 1]
                at, num = place[a:z].astype(np.int64), s["number"][a:z].astype(np.int64)
                doc = ids[np.searchsorted(off, at, "right") - 1]
                left, right = s["left"][a:z].astype(np.int64), s["right"][a:z].astype(np.int64)
                # owners inside the block
                own = np.flatnonzero((s["least"][num] < doc) & (left + right >= length))
                start, end = [at[own] - np.minimum(left[own], before)], [at[own] - np.maximum(0, length - right[own]) + length]
                # owners told by the buckets
                f, t = np.searchsorted(number, num), np.searchsorted(number, num, "right")
                who = np.repeat(np.arange(len(num)), t - f)
                which = np.repeat(f - np.r_[0, np.cumsum(t - f)[:-1]], t - f) + np.arange(len(who)) if len(who) else who
                less = owner[which] < doc[who] if len(who) else np.zeros(0, bool)
                who, which = who[less], which[less]
                start.append(at[who] - hi[which]), end.append(at[who] - lo[which] + length)
                cover = np.bincount(np.concatenate(start), minlength=len(data) + 1) - np.bincount(np.concatenate(end), minlength=len(data) + 1)
                gone = np.cumsum(cover[: len(data)]) > 0 if len(data) else np.zeros(0, bool)
                edge = np.zeros(len(data) + 1, bool)
                edge[off] = True
                opens = np.flatnonzero(gone & (edge[: len(data)] | ~np.r_[False, gone[:-1]])) if len(data) else np.zeros(0, np.int64)
                closes = np.flatnonzero(gone & (edge[1 : len(data) + 1] | ~np.r_[gone[1:], False])) + 1 if len(data) else opens
                first = np.searchsorted(opens, off)
                kept = data[~gone]
                kept_off = np.r_[0, np.cumsum(~gone)][off]
                spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(opens - np.repeat(off[:-1], np.diff(first)), pa.int64()), pa.array(closes - np.repeat(off[:-1], np.diff(first)), pa.int64())], names=["start", "end"]))
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(np.diff(off), pa.int64()), spans, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_off.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return rows


def sampled_blocks(buckets: int) -> int:
    """How many rows of sampled cores place the splitters: several cores for each bucket, however many there are."""
    return max(512, buckets // 2)


def quantiles(grams: np.ndarray, buckets: int) -> list[bytes]:
    """Distinct splitters, at most ``buckets`` - 1, from sorted sampled grams."""
    return sorted({bytes(grams[i * len(grams) // buckets]).ljust(GRAM, b"\0") for i in range(1, buckets)}) if len(grams) else []


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the maximal removed runs), kept (the remaining bytes) of every row of ``docs``."""
    if not GRAM < length <= 255:
        raise ValueError(f"length must lie between {GRAM + 1} and 255")
    ws = Workspace(spark, "suffix")
    docs = settled(ws, plain(docs, "doc_id", "text"))
    parts = partitions_for(spark, docs)
    sent = docs.mapInArrow(tidy(_write_blocks(ws.path, length, parts)), _MESSAGE_SQL)
    shared = ws.write(sent.repartitionById(parts, F.col("part")).select("block", "kind", "blob").mapInArrow(tidy(_shared_grams), _REPLY_SQL), "shared")
    totals = shared.where(F.col("kind") == TOTALS).select("blob").collect()  # two numbers a range
    cool, hot = np.frombuffer(b"".join(bytes(r["blob"]) for r in totals), np.int64).reshape(-1, 2).sum(axis=0).tolist()
    near, far = sides(length)
    buckets = max(partitions_for(spark), (cool + hot * (near.last + 1)) * length // BUCKET_BYTES)
    samples = shared.where(F.col("kind") == SAMPLE).select("blob", F.xxhash64("blob").alias("key"))
    wanted = sampled_blocks(buckets)
    sample = smallest_hashes(samples, F.col("key"), samples.count(), wanted).orderBy("key", "blob").limit(wanted).select("blob").collect()  # a few hundred bytes a bucket
    splitters = quantiles(np.sort(np.frombuffer(b"".join(bytes(r["blob"]) for r in sample), f"S{max(near.size, far.size)}")), buckets)
    told = shared.where("block >= 0").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(_send_contexts(ws.path, length, splitters, buckets)), _MESSAGE_SQL)
    owners = ws.write(told.repartitionById(max(len(splitters) + 1, buckets), F.col("part")).select("block", "kind", "blob").mapInArrow(tidy(_owners(length)), _REPLY_SQL), "owners")
    return owners.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(_results(ws.path, length)), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
