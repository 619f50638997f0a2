"""Token counts of whole texts by overlap resynchronisation.

Texts up to ``chunk_chars`` characters are encoded as they are. A longer text is cut into chunks that overlap;
each chunk is encoded with offsets, and neighbouring encodings are spliced where both have a token boundary
that is proven stable:

* for a ``tokenizers`` file, the boundary is a character of plain white space (space, tab, line feed, carriage return) between
  two others that are none: such vocabularies normalise, split and merge within runs of other characters only.
  Where the tokens of the overlap agree on both sides of such a place, the splice is made there;
* if no such place lies in the overlap, or the tokens around it differ, the overlap is widened (doubled), at last to the whole rest.

So the spliced count equals that of the whole text while no single call encodes more than a chunk and its overlap
(unless the text itself has no boundary). Runs of one document's chunks stay in one task.

Where white space gives no tokens, the encoder remembers the counts of the units between white space for short texts,
which is the same stability property;
texts with the tokenizer's special strings always go through the library whole.

Null counts as an empty text (0 bytes, 0 tokens). Repeated and null doc_ids each give their row. An empty table gives no rows. Extra
columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import TextView, plain, tidy

CHUNK_CHARS, OVERLAP_CHARS, SLICE = 32_768, 512, 1 << 20
#: Plain white space at which a text can be cut, and code points whose class as white space differs between libraries.
CUT = re.compile(r"(?<=[^\s])[ \t\n\r](?=[^\s])")
DOUBTFUL = re.compile("[\x1c-\x1f\x85]")
_LOADED: dict = {}


def load(path: str):
    """Tokenizer of the file, once per worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = t
    return _LOADED[path]


class Encoder:
    """encode(text) -> (ids, starts, ends) with character offsets; count(texts) -> token counts."""

    MEMO, LONGEST, STALE = 300_000, 40, 0.7  # units remembered; a full memo starts anew where less than STALE of a slice's units are in it

    def __init__(self, path: str):
        self.tok, self.piece = load(path), path.endswith(".model")
        self.memo: dict[bytes, int] = {}
        self.special = None
        if not self.piece:
            names = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
            self.special = re.compile("|".join(names)) if names else None
        #: Only where white space itself gives no tokens are the units between it independent of it.
        self.drops_space = not self.piece and self._plain_counts([" \n\t", "a \n b"]) == [0, sum(self._plain_counts(["a", "b"]))]

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        if self.piece:
            out = self.tok.encode(text, return_type="proto")
            return [p.id for p in out.pieces], [(p.begin, p.end) for p in out.pieces]
        e = self.tok.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def _plain_counts(self, texts: list[str]) -> list[int]:
        if self.piece:
            return [len(x) for x in self.tok.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of texts that need no cutting."""
        if not self.drops_space:
            return self._plain_counts(texts)
        whole = [i for i, t in enumerate(texts) if DOUBTFUL.search(t) or self.special is not None and self.special.search(t)]
        out, skip = [0] * len(texts), set(whole)
        for i, n in zip(whole, self._plain_counts([texts[i] for i in whole]), strict=True):
            out[i] = n
        units, ends = [], []
        for i, t in enumerate(texts):
            if i not in skip:
                units += t.encode().split()
            ends.append(len(units))
        got = list(map(self.memo.get, units))
        missing = [k for k, x in enumerate(got) if x is None]
        if missing:
            ask, fresh = list({units[k] for k in missing}), {}
            for at in range(0, len(ask), 2000):
                part = ask[at : at + 2000]
                fresh.update(zip(part, self._plain_counts([u.decode() for u in part]), strict=True))
            for k in missing:
                got[k] = fresh[units[k]]
            if len(self.memo) > self.MEMO and len(missing) > (1 - self.STALE) * len(units):
                self.memo.clear()
            if len(self.memo) <= self.MEMO:
                self.memo.update((u, n) for u, n in fresh.items() if len(u) <= self.LONGEST)
        upto = np.r_[0, np.cumsum(np.array(got, np.int64))]
        for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
            if i not in skip:
                out[i] = int(upto[z] - upto[a])
        return out


def encoder_of(path: str) -> Encoder:
    """Once per worker process, with its memo."""
    if ("encoder", path) not in _LOADED:
        _LOADED["encoder", path] = Encoder(path)
    return _LOADED["encoder", path]


class Resync:
    """Counts the tokens of one huge text from overlapping chunks."""

    def __init__(self, encoder: Encoder, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.encoder, self.chunk, self.overlap, self.widened = encoder, chunk, overlap, 0

    def splice(self, text: str, left: tuple, right: tuple, start: int) -> tuple[int, int, int] | None:
        """(tokens of left to keep, tokens of right to drop, place) at a stable boundary; left and right hold (first character, spans)."""
        a0, (_, a) = left[0], left[1]
        b0, (_, b) = right[0], right[1]
        end = a0 + left[2]
        places = [m.start() for m in CUT.finditer(text, start + 1, end - 1)]
        a_at, b_at = np.array([s for s, _ in a] or [0]) + a0, np.array([s for s, _ in b] or [0]) + b0
        for p in sorted(places, key=lambda p: abs(2 * p - start - end)):
            i, j = int(np.searchsorted(a_at, p)), int(np.searchsorted(b_at, p))
            lo, hi = max(0, min(i, j, 4)), min(len(a) - i, len(b) - j, 4)  # the tokens on both sides agree
            same = all((a[i + k][0] + a0, a[i + k][1] + a0, left[1][0][i + k]) == (b[j + k][0] + b0, b[j + k][1] + b0, right[1][0][j + k]) for k in range(-lo, hi))
            if same and lo and hi:
                return i, j, p
        return None

    def count(self, text: str) -> int:
        total, dropped = 0, 0
        at, size = 0, self.chunk
        left = (0, self.encoder.spans(text[:size]), min(size, len(text)))
        while left[0] + left[2] < len(text):
            end, overlap, found = left[0] + left[2], self.overlap, None
            while found is None:
                at = max(left[0], end - overlap)
                if at == left[0]:  # no stable place in the whole chunk: take it together with what follows
                    size = min(len(text) - at, 2 * left[2])
                    left, dropped_now = (at, self.encoder.spans(text[at : at + size]), size), True
                    self.widened += 1
                    break
                right = (at, self.encoder.spans(text[at : at + self.chunk]), min(self.chunk, len(text) - at))
                found, overlap = self.splice(text, left, right, at), overlap * 2
                self.widened += found is None
            else:
                i, j, _ = found
                total, dropped, left = total + i - dropped, j, right
                continue
            if dropped_now and dropped:  # the longer chunk starts where the old one did, so what is dropped at its start stays the same
                continue
        return total + len(left[1][0]) - dropped


def count_column(column: pa.Array, encoder: Encoder, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    view = TextView(column)
    out = np.zeros(len(view), np.int64)
    for i, j, data, off in view.slices(SLICE):
        raw = data.tobytes()
        texts = [raw[off[k] : off[k + 1]].decode("utf-8", "replace") for k in range(j - i)]
        short = [k for k, t in enumerate(texts) if len(t) <= chunk]
        out[[i + k for k in short]] = encoder.counts([texts[k] for k in short])
        for k in {*range(j - i)} - {*short}:
            out[i + k] = Resync(encoder, chunk, overlap).count(texts[k])
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            n = count_column(b.column("text"), encoder, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(TextView(b.column("text")).lengths), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return plain(docs, "doc_id", "text").mapInArrow(tidy(rows), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
