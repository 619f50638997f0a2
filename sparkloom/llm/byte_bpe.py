"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are split as the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` splits
them, without a regular expression:

* a codepoint-class array maps each code point to letter, number, white space or other;
* with at most three code points of look-ahead every position gets a symbol (a letter, a blank that joins what follows, a blank
  inside a run, an apostrophe that opens a contraction, the first position of a document, ...);
* a symbol is a transition function over eight states (in a run of letters, behind a joining blank, inside a contraction, ...).
  Composition of transition functions is associative. The functions that symbols generate form a small monoid whose
  multiplication table is built once, so a scan combines whole blocks of positions at once: block products, then a scan over
  block products (recursively), then states within blocks. State and symbol give the token boundaries.

The slices between boundaries are looked up in a cache; a slice that is new is merged pair by pair, lowest rank first, with a
heap and linked list (n log n, so a slice without any boundary stays feasible). Byte offsets of slices are retained,
so ids map back to spans, and decoding joins the vocabulary's bytes.

Null counts as an empty text: no ids. Very long texts are encoded whole, one at a time. Repeated and null doc_ids each give their row;
an empty table gives no rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.llm.common import TextView, plain, tidy

SLICE = 1 << 19
LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Ranges of letters and numbers assigned after Unicode 16, which the merge library's tables do not know yet.
AFTER_16 = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2,
    0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5,
    0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f),
    (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80,
    0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81),
    (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe,
    0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, from the property tables of the ``regex`` package (newer than ``unicodedata``'s)."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, prop in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            out[np.frombuffer("".join(regex.findall(prop, every)).encode("utf-32-le"), np.uint32)] = kind
        for a, b in AFTER_16:
            out[a : b + 1] = OTHER
        out[WHITE_SPACE] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


# ---------------------------------------------------------------- symbols, states, monoid

#: Symbols. BLANK_IN: white space with more behind it, or at the end; BLANK_JOIN: a U+0020 before a visible character;
#: BLANK_LAST: other white space before one; APOS1 and APOS2: an apostrophe before a contraction of one or two letters.
SYM_LETTER, SYM_NUMBER, SYM_OTHER, BLANK_IN, BLANK_JOIN, BLANK_LAST, APOS1, APOS2 = range(8)
#: States. FRESH: a token starts in any case.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, JOINING, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, sym: int) -> tuple[int, bool]:
    """(next state, whether a token starts here)."""
    if sym == SYM_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if sym == SYM_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if sym == SYM_OTHER:
        return IN_OTHER, state not in (IN_OTHER, JOINING)
    if sym == BLANK_IN:
        return IN_BLANKS, state != IN_BLANKS
    if sym == BLANK_JOIN:
        return JOINING, True
    if sym == BLANK_LAST:
        return FRESH, True
    if state in (IN_OTHER, JOINING):  # the apostrophe belongs to a run of others
        return IN_OTHER, False
    return (ONE_MORE if sym == APOS1 else TWO_MORE), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, multiplication table: first f then g, image of each state under each element).

    Symbols 8 to 15 are those at a document's first position: they ignore the state before.
    """
    gens = [tuple(_step(s, sym)[0] for s in range(8)) for sym in range(8)]
    gens += [(g[FRESH],) * 8 for g in gens]
    index: dict[tuple, int] = {tuple(range(8)): 0}
    for g in gens:
        index.setdefault(g, len(index))
    todo = list(index)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(index)
                todo.append(h)
    elements = list(index)
    table = np.array([[index[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
    return np.array([index[g] for g in gens], np.uint16), table, np.array(elements, np.uint8)


_GEN, _MUL, _APPLY = _monoid()
_SIZE = len(_MUL)
_MUL_FLAT = _MUL.ravel()
_STARTS = np.array([[_step(s, sym % 8)[1] or sym >= 8 for sym in range(16)] for s in range(8)]).ravel()
_NEXT = np.array([[_step(FRESH if sym >= 8 else s, sym % 8)[0] for sym in range(16)] for s in range(8)], np.uint8).ravel()
_LANE = 128


def scan(elements: np.ndarray) -> np.ndarray:
    """Exclusive prefix products of monoid elements (associative, by blocks)."""
    n = len(elements)
    if n <= _LANE:
        out, acc = np.zeros(n, np.uint16), 0
        for i, e in enumerate(elements.tolist()):
            out[i] = acc
            acc = int(_MUL_FLAT[acc * _SIZE + e])
        return out
    lanes = -(-n // _LANE)
    padded = np.zeros(lanes * _LANE, np.uint16)
    padded[:n] = elements
    cols = np.ascontiguousarray(padded.reshape(lanes, _LANE).T).astype(np.intp)
    acc = np.zeros(lanes, np.intp)
    inner = np.empty((_LANE, lanes), np.uint16)
    for k in range(_LANE):  # products within each block, all blocks at once
        inner[k] = acc
        acc = _MUL_FLAT[acc * _SIZE + cols[k]].astype(np.intp)
    before = scan(acc.astype(np.uint16)).astype(np.intp)  # products of the blocks before
    return np.ascontiguousarray(_MUL_FLAT[before[None, :] * _SIZE + inner].T).ravel()[:n]


def boundaries(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point. codes: documents one after another; firsts: where documents start."""
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n + 4, bool)
    first[firsts] = True
    first[n:] = True
    first = first[: n + 4]
    ext = np.r_[codes, np.zeros(4, codes.dtype)]
    k = np.r_[kind, np.full(4, OTHER, np.uint8)]
    sym = np.array([SYM_LETTER, SYM_NUMBER, BLANK_IN, SYM_OTHER], np.uint8)[kind]
    blank = np.flatnonzero(kind == SPACE)
    last = blank[~first[blank + 1] & (k[blank + 1] != SPACE)]
    sym[last] = np.where(codes[last] == 0x20, BLANK_JOIN, BLANK_LAST)
    apos = np.flatnonzero(codes == 0x27)
    apos = apos[~first[apos + 1]]
    one, two = ext[apos + 1], np.where(first[apos + 2], 0, ext[apos + 2])
    sym[apos[np.isin(one, [ord(c) for c in "stmd"])]] = APOS1
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    sym[apos[pair]] = APOS2
    sym[firsts] += 8
    states = _APPLY[scan(_GEN[sym]), FRESH]
    return _STARTS[states.astype(np.intp) * 16 + sym]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each) of valid UTF-8."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), at


def token_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all slices, index of each document's first slice, with the end). data: valid UTF-8."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    codes, at = code_points(data)
    firsts = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    starts = at[boundaries(codes, firsts)]
    return starts, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- merging


class Ranks:
    """A vocabulary of ranks: pair merging, cache of slices, decoding.

    The cache stops growing at ``CACHE`` slices, and starts anew where less than ``STALE`` of a block's slices are in a full one.
    """

    CACHE, LONGEST, STALE = 300_000, 64, 0.7

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        if (r := self.rank.get(piece)) is not None:
            return [r]
        n, rank = len(piece), self.rank
        end, prev, nxt = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if end[i] < 0 or nxt[i] >= n or end[nxt[i]] != e:
                continue  # one of the two has been merged since
            j = nxt[i]
            end[i], end[j], nxt[i] = e, -1, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := rank.get(piece[i : end[nxt[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[j]]))
            if prev[i] >= 0 and (r := rank.get(piece[prev[i] : e])) is not None:
                heapq.heappush(heap, (r, prev[i], e))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = nxt[i]
        return out

    def encode_slices(self, raw: bytes, starts: list[int]) -> list[bytes]:
        """ids of each slice as little-endian uint32 bytes. starts: byte starts, with the end."""
        pieces = [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        cache, merge, pack = self.cache, self.merge, array
        out = list(map(cache.get, pieces))
        missing = [k for k, x in enumerate(out) if x is None]
        if missing:
            fresh = {p: pack("I", merge(p)).tobytes() for p in {pieces[k] for k in missing}}
            for k in missing:
                out[k] = fresh[pieces[k]]
            if len(cache) > self.CACHE and len(missing) > (1 - self.STALE) * len(pieces):
                cache.clear()
            if len(cache) <= self.CACHE:
                cache.update((p, x) for p, x in fresh.items() if len(p) <= self.LONGEST)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_LOADED: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    if path not in _LOADED:
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids binary (little-endian uint32), and with offsets: starts binary (uint32 byte start of each slice), slice_ids binary (ids per slice)."""
    schema = "doc_id long, ids binary" + (", starts binary, slice_ids binary" if with_offsets else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for b in batches:
            view = TextView(b.column("text"))
            ids = b.column("doc_id").cast(pa.int64())
            for i, j, data, off in view.slices(SLICE):
                starts, first = token_slices(data, off)
                parts = r.encode_slices(data.tobytes(), [*starts.tolist(), len(data)])
                f = first.tolist()
                cols = [ids.slice(i, j - i), pa.array([b"".join(parts[f[k] : f[k + 1]]) for k in range(j - i)], pa.binary())]
                if with_offsets:
                    n = np.array([len(p) // 4 for p in parts], "<u4")
                    cols.append(pa.array([(starts[f[k] : f[k + 1]] - off[k]).astype("<u4").tobytes() for k in range(j - i)], pa.binary()))
                    cols.append(pa.array([n[f[k] : f[k + 1]].tobytes() for k in range(j - i)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "starts", "slice_ids"][: len(cols)])

    return plain(docs, "doc_id", "text").mapInArrow(tidy(rows), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and decoded binary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [r.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(rows), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded and summed up in one pass, so ids and bytes stay in the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for b in batches:
            view, out = TextView(b.column("text")), []
            for i, j, data, off in view.slices(SLICE):
                starts, first = token_slices(data, off)
                parts, f = r.encode_slices(data.tobytes(), [*starts.tolist(), len(data)]), first.tolist()
                for k in range(j - i):
                    ids = b"".join(parts[f[k] : f[k + 1]])
                    out.append((len(ids) // 4, digest(ids), digest(r.decode(np.frombuffer(ids, "<u4")))))
            n, coded, decoded = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain(docs, "doc_id", "text").mapInArrow(tidy(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
