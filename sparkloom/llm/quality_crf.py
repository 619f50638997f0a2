"""Quality of documents by a linear-chain conditional random field over their lines.

Every line that is not empty is a step of the chain with label good or bad. Its observation: about twenty shares and
counts of the line (length, character kinds, word lengths, repeated words, repetition of the whole line in the document, edges), the
same for the line before and the line after, and whether it is the first or last. Trained by the likelihood of whole
chains, in which each line carries its document's label (L2 penalty, Adam, full batches); the fit is on a bounded sample: the
``sample`` labelled documents with the smallest hash of their doc_id, of which those of at most ``sample_bytes`` bytes and
``sample_lines`` lines are used.

A document's score is the length-weighted mean of its lines' forward-backward marginals for good. Texts without lines score
the share of good documents in training. Whole texts count: bytes are looked at window by window, what stays in memory is some
200 bytes a line, and chains of many lines advance in blocks, so a text of a million lines takes seconds.

Null text counts as empty. Labels other than 0 and 1 or null are left out; of repeated labels of a document the smaller counts,
and of repeated rows of a labelled doc_id one is learnt from, while each is scored with its own text. Rows without doc_id are scored
and not held out. Without labelled documents of both kinds the score is that share (0.5 if there are none). Empty tables give no
rows. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import IS_GAP, U64, TextView, plain, smallest_hashes, tidy, word_hashes

_KIND = np.full(256, 5, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 blank, 4 sentence mark, 5 other ASCII mark, 6 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[32, 9, 11, 12, 13]] = 0, 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[128:] = 6
_MARKS = np.zeros((4, 256), bool)
for _k, _s in enumerate(("!", "%&#$*", "<>{}[]|\\/=_", "@")):
    _MARKS[_k, [ord(c) for c in _s]] = True
KINDS, SUMS, SHAPES = 7, 13, 20
WINDOW = 1 << 18


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what adds up over a line's bytes (lines, SUMS), word hashes, line of each word) of lines that lie in ``data`` in order."""
    kind, m = _KIND[data], len(starts)
    out = np.empty((m, SUMS))

    def total(mask: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=acc[1:])
        return acc[ends] - acc[starts]

    for k in range(KINDS):
        out[:, k] = total(kind == k)
    out[:, KINDS] = total((data & 0xC0) != 0x80)
    other = kind == 5
    out[:, KINDS + 1] = total(np.r_[False, other[1:] & other[:-1]])
    for k, marks in enumerate(_MARKS):
        out[:, KINDS + 2 + k] = total(marks[data])
    h, line = word_hashes(data, np.unique(np.r_[0, starts, ends, len(data)]))
    cut = np.unique(np.r_[0, starts, ends, len(data)])
    at = np.searchsorted(starts, cut[line], "right") - 1
    inside = (at >= 0) & (cut[line] < ends[np.maximum(at, 0)])
    return out, h[inside], at[inside]


def _distinct(h: np.ndarray, line: np.ndarray, m: int) -> np.ndarray:
    by = np.lexsort((h, line))
    hs, ls = h[by], line[by]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])] if len(hs) else np.zeros(0, bool)
    return np.bincount(ls[new], minlength=m)


def _long_line(data: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """(sums, words, distinct words, signature) of one line, in windows that end behind white space where there is some."""
    sums, seen, words, sig, at = np.zeros(SUMS), [], 0, 0, 0
    while at < len(data):
        to = min(at + WINDOW, len(data))
        if to < len(data) and len(gaps := np.flatnonzero(IS_GAP[data[at:to]])):
            to = at + int(gaps[-1]) + 1
        own, h, _ = _sums(data[at:to], np.zeros(1, np.int64), np.array([to - at]))
        sums += own[0]
        words, sig = words + len(h), (sig + int(h.sum(dtype=U64))) % (1 << 64)
        seen.append(np.unique(h))
        at = to
    return sums, words, len(np.unique(np.concatenate(seen))), sig


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, SHAPES) float32, row of each line, bytes of each line) of the lines that are not empty.

    Bytes are looked at in windows of ``WINDOW``; what is kept is proportional to the number of lines. Words longer than a window count as
    several.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    starts = starts[starts < n]
    ends = np.r_[starts[1:], n][: len(starts)]
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    full = ends > starts
    starts, ends = starts[full], ends[full]
    m = len(starts)
    if not m:
        return np.zeros((0, SHAPES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    sums, words, distinct, sig = np.empty((m, SUMS), np.float32), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, U64)
    a = 0
    while a < m:
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + WINDOW, "right")))
        if ends[a] - starts[a] > WINDOW:
            z = a + 1
            sums[a], words[a], distinct[a], sig[a] = _long_line(data[starts[a] : ends[a]])
        else:
            sums[a:z], h, line = _sums(data[starts[a] : ends[z - 1]], starts[a:z] - starts[a], ends[a:z] - starts[a])
            words[a:z], distinct[a:z] = np.bincount(line, minlength=z - a), _distinct(h, line, z - a)
            with np.errstate(over="ignore"):
                np.add.at(sig[a:z], line, h)
        a = z
    size = (ends - starts).astype(np.float64)
    by = np.lexsort((sig, row))
    same = (sig[by][1:] == sig[by][:-1]) & (row[by][1:] == row[by][:-1])
    again = np.zeros(m, bool)
    again[by[1:]] |= same
    again[by[:-1]] |= same
    last, first, w1 = _KIND[data[ends - 1]], _KIND[data[starts]], np.maximum(1, words)
    x = np.empty((m, SHAPES), np.float32)
    columns = [
        np.log1p(size), *(sums[:, k] / size for k in range(KINDS)), np.log1p(words), np.maximum(1, sums[:, KINDS]) / w1 / 10, distinct / w1, again,
        *(sums[:, KINDS + 1 + k] / w1 for k in range(5)), last == 4, first == 0, sums[:, 0] / np.maximum(1, sums[:, 0] + sums[:, 1]),
    ]
    for k, c in enumerate(columns):
        x[:, k] = c
    return x, row, size.astype(np.int64)


def observations(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own, previous and next features, edges and a constant."""
    m = len(x)
    first = np.r_[True, row[1:] != row[:-1]] if m else np.zeros(0, bool)
    last = np.r_[first[1:], True] if m else first
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((m, 1))], axis=1).astype(np.float32)


WIDTH = 3 * SHAPES + 3


@dataclass
class Model:
    """score(good) - score(bad) of a line is weights @ (observation - mean) / scale; ``pair`` scores neighbouring labels."""

    weights: np.ndarray
    pair: np.ndarray  # [label, next label], 1 is good
    mean: np.ndarray
    scale: np.ndarray
    share: float

    def unary(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The score of every line, some lines at a time with their neighbours."""
        out = np.empty(len(x))
        for a in range(0, len(x), 8192):
            z, before = min(a + 8192, len(x)), min(a, 1)
            obs = observations(x[a - before : z + 1], row[a - before : z + 1])[before : before + z - a]
            out[a:z] = ((obs - self.mean) / self.scale) @ self.weights
        return out


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(unary: np.ndarray, row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of good for each line, log normaliser for each chain, chain of each line, expected label pairs (2, 2)).

    All chains advance together, longest first, so the active ones are a prefix.
    """
    m = len(unary)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if m else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, m])
    by = np.argsort(-length, kind="stable")
    start, length = start[by], length[by]
    alpha, beta = np.zeros((m, 2)), np.zeros((m, 2))
    active = np.searchsorted(-length, -np.arange(1, (length[0] if m else 0) + 1), "right")
    at = start
    alpha[at, 1] = unary[at]
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] = _lse(a[:, 0] + pair[0, 0], a[:, 1] + pair[1, 0])
        alpha[at, 1] = _lse(a[:, 0] + pair[0, 1], a[:, 1] + pair[1, 1]) + unary[at]
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        b0, b1 = beta[at, 0], beta[at, 1] + unary[at]
        beta[at - 1, 0] = _lse(pair[0, 0] + b0, pair[0, 1] + b1)
        beta[at - 1, 1] = _lse(pair[1, 0] + b0, pair[1, 1] + b1)
    total = alpha + beta
    norm = _lse(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - norm)
    inner = np.flatnonzero(np.r_[False, row[1:] == row[:-1]]) if m else start
    expected = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            expected[i, j] = np.exp(alpha[inner - 1, i] + pair[i, j] + j * unary[inner] + beta[inner, j] - norm[inner]).sum()
    return good, norm[start], by, expected


BLOCK = 512


def _odds(unary: np.ndarray, start: np.ndarray, length: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """z of each line of the chains: z = unary + G(z of the line before), where G(r) carries log odds over ``pair``.

    All chains advance together, and those of more than ``BLOCK`` lines in blocks: G is a Moebius map of the odds, so a block's lines
    compose to a 2 x 2 matrix; matrices of all blocks are made together, one pass over a chain's blocks gives where each begins.
    """

    def step(z):
        return np.logaddexp(pair[0, 1], z + pair[1, 1]) - np.logaddexp(pair[0, 0], z + pair[1, 0])

    pieces = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(start)), pieces)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, size = start[chain] + place * BLOCK, np.minimum(BLOCK, length[chain] - place * BLOCK)
    first = unary[at].copy()
    long = np.flatnonzero(place < pieces[chain] - 1)  # whole blocks that another follows
    if len(long):
        m = np.zeros((2, 2, len(long)))  # m[i, j]: log weight from label i before the block to label j at its end
        m[0, 1] = m[1, 0] = -np.inf
        for t in range(BLOCK):
            u = unary[at[long] + t]
            m = np.stack([np.stack([np.logaddexp(m[i, 0] + pair[0, j], m[i, 1] + pair[1, j]) + j * u for j in (0, 1)]) for i in (0, 1)])
            m -= m.max(axis=(0, 1))
        z = 0.0
        for k, b in enumerate(long.tolist()):
            if place[b] == 0:  # a chain's first line has no line before
                own, mine = 0.0, at[b]
                own = unary[mine]
                rest = unary[mine + 1 : mine + BLOCK]
                for u in rest.tolist():
                    own = u + float(step(own))
                z = own
            else:
                z = float(np.logaddexp(m[0, 1, k], z + m[1, 1, k]) - np.logaddexp(m[0, 0, k], z + m[1, 0, k]))
            first[b + 1] = unary[at[b + 1]] + float(step(z))
    by = np.argsort(-size, kind="stable")
    at, size, z = at[by], size[by], first[by]
    out = np.empty(len(unary))
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for t, n in enumerate(active.tolist()):
        z = z[:n] if t == 0 else unary[at[:n] + t] + step(z[:n])
        out[at[:n] + t] = z
    return out


def marginals(unary: np.ndarray, row: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The forward-backward marginal of good for each line."""
    m = len(unary)
    if not m:
        return np.zeros(0)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[start, m])
    ahead = _odds(unary, start, length, pair)
    back = _odds(unary[::-1], (m - start - length)[::-1], length[::-1], pair.T)[::-1]
    return 1 / (1 + np.exp(-np.clip(ahead + back - unary, -700, 700)))


def train(obs: np.ndarray, row: np.ndarray, label: np.ndarray, share: float, steps: int = 150, penalty: float = 3.0) -> Model:
    """label: of each line (its document's)."""
    mean, scale = obs.mean(axis=0), obs.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0.0, 1.0
    x = (obs - mean) / scale
    docs = len(np.unique(row))
    same = np.r_[False, row[1:] == row[:-1]]
    seen = np.array([[(same & (label == 0)).sum(), 0], [0, (same & (label == 1)).sum()]], float)
    theta, m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    best = theta
    for t in range(1, steps + 1):
        w, pair = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, _, _, expected = forward_backward(x @ w, row, pair)
        grad = np.r_[x.T @ (label - good) - penalty * np.r_[w[:-1], 0], (seen - expected - 10 * penalty * pair).ravel()] / docs
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        best = theta
    return Model(best[:WIDTH], best[WIDTH:].reshape(2, 2), mean, scale, share)


def document_scores(model: Model | None, share: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, share)
    x, row, size = line_table(data, offsets)
    if model is not None and len(row):
        good = marginals(model.unary(x, row), row, model.pair)
        weight = np.bincount(row, size, minlength=len(out))
        has = weight > 0
        out[has] = np.bincount(row, good * size, minlength=len(out))[has] / weight[has]
    return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 1 << 16, sample_lines: int = 1000) -> tuple[Model | None, float]:
    """labels: doc_id, quality; only rows outside the held-out quarter are read."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    near = smallest_hashes(known, F.xxhash64("doc_id"), known.count(), sample)
    picked = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a stated bound
    rows = docs.join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= sample_bytes).select("doc_id", "text", "quality")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view, ids, q = TextView(b.column("text")), b.column("doc_id").to_numpy(), b.column("quality").to_numpy()
            for i, j, data, off in view.slices(WINDOW):
                x, row, _ = line_table(data, off)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                keep = np.flatnonzero(np.diff(cut) <= sample_lines)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][keep]), pa.array(q[i:j][keep], pa.int32()), pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in keep], pa.binary())], names=["doc_id", "quality", "x"])

    one = rows.mapInArrow(lines, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # of rows that repeat a doc_id
    got = one.collect()  # at most ``sample`` rows of at most 80 * ``sample_lines`` bytes
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    parts = [(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, SHAPES), r["quality"]) for r in got]
    share = float(np.mean([q for _, q in parts])) if parts else 0.5
    parts = [(x, q) for x, q in parts if len(x)]
    if len({q for _, q in parts}) < 2:
        return None, share
    x = np.concatenate([p for p, _ in parts])
    row = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
    return train(observations(x, row), row, np.array([q for _, q in parts], float)[row], share), share


def score(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """doc_id, score for every row; other columns of ``docs`` (but for text) are carried along if asked for by name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [document_scores(model, share, data, off) for _, _, data, off in TextView(b.column("text")).slices(WINDOW)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return plain(docs, "doc_id", "text").mapInArrow(tidy(rows), "doc_id long, score double")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) of every row of ``docs``."""
    model, share = fit(spark, plain(docs, "doc_id", "text"), plain(labels, "doc_id", "quality"))
    out = score(docs, model, share)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
