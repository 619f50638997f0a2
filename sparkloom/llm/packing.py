"""Mixture-controlled packing of token ids into sequences of a fixed length.

The documents of a source are a queue, in order of doc_id. A window is a round of deficit round-robin that stands for ``window`` tokens: it gives every
queue credit in proportion to its target (by default its share of all tokens, so all queues end together), and each queue in turn sends whole
packets, which are documents or pieces of ``packet`` tokens of longer ones, while its credit lasts. What is left of the credit, less than a packet, is
carried into the next window; a queue that is empty leaves its share to the others. So after every window each queue has sent its target
to less than a packet.

The rounds are not simulated. With weight w a queue's credit grows as w * v in virtual time v until its T tokens are sent, all queues together have
S(v) = sum of min(T, w * v), and a packet that ends at token e of its queue goes into the window where S(e / w) lies. This holds for any packet by itself, so
deficits carry over windows and partitions without passing state from task to task; places in queues and in the stream are running totals by
ranges (``operators.numbering``).

The stream of windows is cut into sequences of ``length`` ids. The last tokens that fill none are cut into sequences of powers of two, so nothing is padded.

Texts are read and encoded once: ids are written with two bytes each where the vocabulary fits, the plan is made from lengths alone, and the ids meet their
plan by one shuffle. A queue may hold any share of the rows: nothing is gathered by queue but one row of totals. A source that ``targets`` names has a queue of its own, the others have the queue of their hash, one of ``QUEUES``;
so sources may share a queue (20 of them with odds of 0.3 %), and which do depends on their names only, not on how many there are.

Null and empty texts are the end id alone. Rows that repeat a doc_id, and rows without one (first in their queue), are packed like others. Rows
without source have a queue of their own. An empty table gives no rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import BYTE_CODE, IS_GAP, LOWER, U64, TextView, Workspace, mix64, partitions_for, plain, powers, tidy
from sparkloom.llm.spelling import pieces
from sparkloom.llm.token_records import CODE_BYTES, UnitEncoder
from sparkloom.operators.numbering import running

LENGTH, WINDOW, PACKET, QUEUES = 4096, 65_536, 1024, 65_536
GAP = IS_GAP.copy()
GAP[0x0B:0x0D] = False  # vertical tab and form feed do not cut a long text
DOUBTFUL = np.zeros(256, bool)
DOUBTFUL[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True


#: Classes of bytes between which units end: letters, digits, marks; 0 for all others.
KIND = np.zeros(256, np.uint8)
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
KIND[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) != "'"]] = 3
WORD, MARKS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"), re.compile(rb"[!-&(-/:-@\[-`{-~]+")


def kinds(data: np.ndarray) -> np.ndarray:
    out = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # but for the signs of multiplication and division
    out[lead] = out[lead + 1] = 1
    return out


class WordEncoder(UnitEncoder):
    """ids of texts by a tokenizers file; where white space gives no ids, units between it are remembered (see UnitEncoder's memo).

    Where the vocabulary never joins letters, digits and marks, units end between them too: between ASCII letters or U+00C0 to U+00FF, digits, and ASCII marks
    but for the apostrophe, which contractions need. Such units are asked for many in one text: each is one word, which ends with an id that ends words.
    Units are looked up in lower case where the file ignores case.
    """

    def __init__(self, path: str):
        super().__init__(path)
        one = lambda *t: b"".join(self._ids(list(t)))
        self.drops_space = one(b" \n\t") == b"" and one(b"a \n b") == one(b"a", b"b")
        self.lowers = one(b"ABc Xy") == one(b"abc xy")
        self.parts = self.drops_space and one(b"ab.#Cd12(x") == one(b"ab", b".#", b"Cd", b"12", b"(", b"x")
        self.ends = np.zeros(len(self.lengths), bool)
        for t, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends[i] = t.endswith("</w>")

    def _words(self, ask: list[bytes]) -> dict[bytes, bytes]:
        """The ids of parts that are words each, many in one text."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(ask), 4000):
            part = ask[at : at + 4000]
            raw = self._ids([b" ".join(part)])[0]
            ends = np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1
            if len(ends) != len(part) or ends[-1] * self.width != len(raw):
                out.update(zip(part, self._ids(part), strict=True))
                continue
            a = 0
            for u, z in zip(part, (ends * self.width).tolist(), strict=True):
                out[u] = raw[a:z]
                a = z
        return out

    def _ask(self, units: list[bytes]) -> list[bytes]:
        """The ids of units that the memo has not."""
        words = [u for u in units if self.parts and (WORD.fullmatch(u) or MARKS.fullmatch(u))]
        found = self._words(words)
        rest = [u for u in units if u not in found]
        for at in range(0, len(rest), 4000):
            found.update(zip(rest[at : at + 4000], self._ids(rest[at : at + 4000]), strict=True))
        return [found[u] for u in units]

    def doubtful(self, raw: bytes, data: np.ndarray) -> bool:
        """Whether a text must go through the library as it is."""
        return not self.drops_space or bool(DOUBTFUL[data].any()) or b"\xc2\x85" in raw or any(x in raw for x in self.special)

    def encode_view(self, view: TextView) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, ids of rows) of a column, slice by slice; long texts in pieces between white space."""
        for i, j, data, off in view.slices(CODE_BYTES):
            if j - i == 1 and len(data) > CODE_BYTES and not self.doubtful(data.tobytes(), data):
                row = TextView(pa.array([data.tobytes()], pa.large_binary()))
                yield i, [b"".join(x for _, d, o in pieces(row, CODE_BYTES, GAP) for x in self.encode(d, o))]
            else:
                yield i, self.encode(data, off)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw, m = data.tobytes(), len(offsets) - 1
        out: list[bytes] = [b""] * m
        whole = np.zeros(m, bool)
        if self.doubtful(raw, data):  # of the slice: look at each text
            off = offsets.tolist()
            whole = np.array([self.doubtful(raw[a:z], data[a:z]) for a, z in zip(off, off[1:], strict=False)], bool)
            for i in np.flatnonzero(whole).tolist():
                out[i] = self._ids([raw[off[i] : off[i + 1]]])[0]
        if not len(data) or whole.all():
            return out
        if self.lowers:
            data = LOWER[data]
            raw = data.tobytes()
        solid = ~IS_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        apart = np.zeros(len(data) + 1, bool)
        if self.parts:
            kind = kinds(data)
            apart[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1] | apart[:-1]))
        ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:] | apart[1:])) + 1
        row = np.searchsorted(offsets, starts, "right") - 1
        if whole.any():
            cut = ~whole[row]
            starts, ends, row = starts[cut], ends[cut], row[cut]
        if not len(starts):
            return out
        p, q = powers(len(data))
        with np.errstate(over="ignore"):
            acc = np.zeros(len(data) + 1, U64)
            np.cumsum(BYTE_CODE[data] * p, out=acc[1:])
            h = mix64((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        entry, size = self._find(h), ends - starts
        known = np.flatnonzero(entry >= 0)
        if len(known):  # equal hashes are compared byte by byte
            n = size[known]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(starts[known], n) + inside] != self.bytes[np.minimum(np.repeat(self.unit_at[entry[known]], n) + inside, len(self.bytes) - 1)]
            entry[known[(self.unit_len[entry[known]] != n) | (np.add.reduceat(differ, np.cumsum(n) - n) > 0)]] = -1
        missing = np.flatnonzero(entry < 0)
        stale = self.n >= self.MEMO and len(missing) > (1 - self.STALE) * len(starts)
        if len(missing):
            asked = [raw[a:z] for a, z in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            new = sorted(dict.fromkeys(asked), key=lambda u: len(u) > self.LONGEST)  # long ones behind, where they are not kept
            at = self._grow([(u, True) for u in new], self._ask(new))
            place = dict(zip(new, at.tolist(), strict=True))
            entry[missing] = [place[u] for u in asked]
        n = self.ids_len[entry]
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.ids_at[entry] - before, n) + np.arange(n.sum())]
        total = np.bincount(row, n, minlength=m).astype(np.int64)
        made, upto = ids.tobytes(), np.cumsum(total) * ids.itemsize
        for i, (z, k) in enumerate(zip(upto.tolist(), (total * ids.itemsize).tolist(), strict=True)):
            if k:
                out[i] = made[z - k : z]
        if len(missing):
            self._keep(new, h, entry, missing, stale)
        return out

    def _keep(self, new: list[bytes], h: np.ndarray, entry: np.ndarray, missing: np.ndarray, stale: bool) -> None:
        """Remember the slice's short units while the memo has room; start anew where it has become useless."""
        short = sum(len(u) <= self.LONGEST for u in new)
        if self.n < self.MEMO:
            number, first = np.unique(entry[missing], return_index=True)
            first, number = first[number < self.n + short], number[number < self.n + short]
            if self.n + short > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(max(short, len(self.hashes)), U64)])
            self.hashes[number] = h[missing[first]]
            self._insert(h[missing[first]], number)
            self.n += short
        elif stale:
            self._forget()


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def coded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, doc_tokens, width, ids (little-endian, with the end id) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for i, found in enc.encode_view(TextView(b.column("text"))):
                ids = [x + end for x in found]
                part = b.slice(i, len(ids))
                n = np.array([len(x) for x in ids], np.int64) // enc.width
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source").cast(pa.string()), pa.array(n), pa.array(np.full(len(ids), enc.width, np.int32)), pa.array(ids, pa.binary())], names=["doc_id", "source", "doc_tokens", "width", "ids"])

    return plain(docs, "doc_id", "source", "text").mapInArrow(tidy(rows), "doc_id long, source string, doc_tokens long, width int, ids binary")


# ---------------------------------------------------------------- the plan


class Mixture:
    """Queues with totals and weights: in which window a packet goes that ends at a token of its queue."""

    def __init__(self, totals: Sequence[int], weights: Sequence[float], window: int):
        t, w = np.array(totals, float), np.array(weights, float)
        self.weights, self.window = w, window
        ends = t / w  # virtual time at which a queue is empty
        order = np.argsort(ends, kind="stable")
        self.at = np.r_[0.0, ends[order]]
        gone_t, gone_w = np.r_[0.0, np.cumsum(t[order])], np.r_[0.0, np.cumsum(w[order])]
        self.base, self.rate = gone_t, np.maximum(w.sum() - gone_w, 0.0)  # S(v) = base + rate * v behind at[i]

    def sent(self, v: np.ndarray) -> np.ndarray:
        """S(v): tokens that all queues have been credited at virtual time v."""
        i = np.searchsorted(self.at, v, "left") - 1
        i = np.maximum(i, 0)
        return self.base[i] + self.rate[i] * v

    def windows(self, queue: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = self.sent(end / self.weights[queue]) / self.window
        return np.maximum(np.ceil(got - 1e-9) - 1, 0).astype(np.int64)


PARCEL = "window long, queue int, at long, row long, start long, length long"


def parcels(mix: Mixture, packet: int):
    """For mapInArrow over (row, queue, at, doc_tokens): the packets of each document, those of one window joined."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, queue, at, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "queue", "at", "doc_tokens"))
            many = -(-n // packet)
            doc = np.repeat(np.arange(len(row)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            end = np.minimum((k + 1) * packet, n[doc])
            window = mix.windows(queue[doc], at[doc] + end)
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])]) if len(doc) else np.zeros(0, np.int64)
            last = np.r_[new[1:], len(doc)] - 1 if len(new) else new
            start, d = k[new] * packet, doc[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window[new], queue[d].astype(np.int32), at[d] + start, row[d], start, end[last] - start)], names=["window", "queue", "at", "row", "start", "length"])

    return rows


def cut_points(total: int, length: int) -> np.ndarray:
    """Ends of the sequences behind the last full one: powers of two, falling."""
    full, rest, out = total // length * length, total % length, []
    for k in range(length.bit_length(), -1, -1):
        if rest >> k & 1:
            full += 1 << k
            out.append(full)
    return np.array(out, np.int64)


PIECE = "row long, start long, length long, sequence_id long, offset long"


def cut(total: int, length: int):
    """For mapInArrow over parcels with their place ``g`` in the stream: pieces that lie in one sequence each."""
    whole, tail = total // length, cut_points(total, length)

    def begin(seq: np.ndarray) -> np.ndarray:
        return np.where(seq <= whole, seq * length, tail[np.clip(seq - whole - 1, 0, max(len(tail) - 1, 0))] if len(tail) else 0)

    def of(g: np.ndarray) -> np.ndarray:
        return np.where(g < whole * length, g // length, whole + np.searchsorted(tail, g, "right"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, n, g = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "start", "length", "g"))
            first, last = of(g), of(g + n - 1)
            many = last - first + 1
            own = np.repeat(np.arange(len(row)), many)
            seq = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            a, z = np.maximum(g[own], begin(seq)), np.minimum(g[own] + n[own], begin(seq + 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[own], start[own] + a - g[own], z - a, seq, a - begin(seq))], names=["row", "start", "length", "sequence_id", "offset"])

    return rows


def take(with_ids: bool):
    """For mapInArrow over coded documents with their ``plan``: the pieces, with the CRC-32 of their ids as 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, source, n, width, ids, plan in zip(*[b.column(c) for c in ("doc_id", "source", "doc_tokens", "width", "ids", "plan")], strict=True):
                own = np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}").astype("<u4", copy=False)
                head, tail = doc_id.as_py(), (source.as_py(),)
                for p in plan.as_py():
                    some = own[p["start"] : p["start"] + p["length"]].tobytes()
                    out.append((head, p["start"], p["length"], zlib.crc32(some), n.as_py(), p["sequence_id"], p["offset"], *tail, *([some] if with_ids else [])))
                    size += len(some)
                    if len(out) >= 5000 or with_ids and size > 1 << 24:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["ids"] * with_ids

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    return rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids


def packed(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, targets: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW, packet: int = PACKET, queues: int = QUEUES, with_ids: bool = False
) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, source, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids, 32 bits each).

    ``targets`` gives sources a weight; sources that it does not name have their share of all tokens, times the named ones' mean weight per share. ``length`` is a power of two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    ws = Workspace(spark, "packing")
    texts = ws.write(coded(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "coded")
    bucket = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(queues)).cast("string"))
    own = F.col("source").isin(*[x for x in targets or {} if x is not None])
    name = F.when(own, F.concat(F.lit("="), "source")).when(F.col("source").isNotNull(), bucket)  # whatever the number of sources
    named = {x if x is None else f"={x}": w for x, w in (targets or {}).items()}
    sizes = texts.select("row", "doc_id", "doc_tokens", name.alias("name"))
    sums = sorted(((r["name"], r["n"]) for r in sizes.groupBy("name").agg(F.sum("doc_tokens").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0] or ""))  # at most ``queues`` rows, one for each of ``targets`` and one
    total = sum(n for _, n in sums)
    if not total:
        rows, kind = take(with_ids)
        return spark.createDataFrame([], kind)
    mix = Mixture([n for _, n in sums], weights_of(sums, named), window)
    numbers = spark.createDataFrame([(x, i) for i, (x, _) in enumerate(sums)], "_name string, queue int")
    placed = sizes.join(F.broadcast(numbers), F.col("name").eqNullSafe(F.col("_name"))).select("row", "queue", "doc_id", "doc_tokens")
    parts = partitions_for(spark, docs)
    queued = running(placed, [F.asc_nulls_first("doc_id"), F.col("row")], "at", by=["queue"], weight="doc_tokens", parts=parts, write=lambda df: ws.write(df, "queued"))
    sent = queued.select("row", "queue", "at", "doc_tokens").mapInArrow(tidy(parcels(mix, packet)), PARCEL)
    stream = running(sent, [F.col("window"), F.col("queue"), F.col("at")], "g", weight="length", parts=parts, write=lambda df: ws.write(df, "stream"))
    cuts = stream.select("row", "start", "length", "g").mapInArrow(tidy(cut(total, length)), PIECE)
    plan = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("plan"))  # a document's own pieces
    rows, kind = take(with_ids)
    return texts.join(plan, "row").select("doc_id", "source", "doc_tokens", "width", "ids", "plan").mapInArrow(tidy(rows), kind)


def weights_of(sums: list[tuple[str | None, int]], targets: dict[str | None, float] | None) -> list[float]:
    """Weights of the queues, of sum 1; by default the shares of all tokens."""
    total = sum(n for _, n in sums)
    share = {x: n / total for x, n in sums}
    named = {x: targets[x] for x in share if targets and targets.get(x)}
    scale = sum(named.values()) / sum(share[x] for x in named) if named else 1.0
    raw = [named.get(x, share[x] * scale) for x, _ in sums]
    return [w / sum(raw) for w in raw]


def sequences(pieces_: DataFrame) -> DataFrame:
    """sequence_id, length, ids (32 bits each), parts (offset, doc_id, start, length) of every sequence, from pieces with ids. A group is one sequence."""
    rows = pieces_.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("_p"))
    ids = F.aggregate("_p", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return rows.select("sequence_id", F.aggregate("_p", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("length"), ids.alias("ids"), F.transform("_p", lambda p: p.dropFields("ids")).alias("parts"))
