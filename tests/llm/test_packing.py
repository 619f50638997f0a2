"""Packing: library equality of every piece, no padding, and windows that keep the mixture."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing as P
from sparkloom.llm.common import TextView
from sparkloom.llm.queries import op13_mixture_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, source string, text string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")


def check(pieces, docs, library, length=4096):
    """pieces: rows of the query; docs: (doc_id, text) without repeated doc_ids. Every id lies in one piece, sequences have no gaps and nothing is padded."""
    ids = {d: library(x) for d, x in docs}
    own, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        own[r.doc_id].append((r.start, r.length)), seqs[r.sequence_id].append((r.offset, r.length))
    for got in (own, seqs):
        for rows in got.values():
            at = 0
            for a, n in sorted(rows):
                assert a == at and n > 0
                at += n
    assert {d: sum(n for _, n in x) for d, x in own.items()} == {d: len(x) for d, x in ids.items()}
    sizes = [sum(n for _, n in seqs[k]) for k in sorted(seqs)]
    assert sorted(seqs) == list(range(len(sizes)))
    assert all(n <= length and (n == length or n & (n - 1) == 0) for n in sizes)
    assert sum(n < length for n in sizes) <= length.bit_length()


def test_query_packs_every_id_once(spark, sf, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op13_mixture_packing(spark, sf).collect(), docs, library)


def streams(rows, length):
    """Source of each id in the order of the stream."""
    return [r.source for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) for _ in range(r.length)]


@pytest.mark.parametrize("targets", [None, {"big": 1.0, "small": 1.0}, {"small": 0.9, "big": 0.05}])
def test_windows_keep_the_mixture(spark, targets):
    """After k windows every queue that is not empty has sent its credit to less than a packet."""
    r = random.Random(5)
    rows = [(i, r.choice(["big", "big", "small", None]), "word " * r.choice([0, 1, 7, 60, 700])) for i in range(300)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    window, packet, length = 2000, 100, 256
    got = P.packed(spark, df, PATH, targets=targets, length=length, window=window, packet=packet).collect()
    stream, total = streams(got, length), defaultdict(int)
    for x in stream:
        total[x] += 1
    w = {q: n / len(stream) for q, n in total.items()} if not targets else targets
    named = [q for q in total if q in w]
    sent = dict.fromkeys(total, 0)
    for k, x in enumerate(stream):
        sent[x] += 1
        if (k + 1) % window == 0 and all(sent[q] < total[q] - window for q in named):
            scale = sum(sent[q] for q in named) / sum(w[q] for q in named)
            assert all(abs(sent[q] - scale * w[q]) <= 3 * packet for q in named), (k, sent)
    assert sum(sent.values()) > 5 * window


def test_deficits_are_below_a_packet():
    """The closed form against rounds of deficit round-robin that are played one after the other."""
    r = random.Random(2)
    for weights in ([0.5, 0.3, 0.2], [0.1, 0.1, 0.8]):
        ends = [np.cumsum([r.randint(1, 50) for _ in range(n)]) for n in (400, 100, 250)]
        totals = [int(e[-1]) for e in ends]
        mix = P.Mixture(totals, weights, 500)
        got = [mix.windows(np.full(len(e), q), e) for q, e in enumerate(ends)]
        credit, sent = [0.0] * 3, [0] * 3
        for k in range(sum(totals) // 500 + 2):
            left = 500.0
            while left > 1e-9 and any(credit[q] < totals[q] - 1e-9 for q in range(3)):
                active = [q for q in range(3) if credit[q] < totals[q] - 1e-9]
                rate = sum(weights[q] for q in active)
                step = min([left, *[(totals[q] - credit[q]) * rate / weights[q] for q in active]])
                for q in active:
                    credit[q] += step * weights[q] / rate
                left -= step
            for q, e in enumerate(ends):
                while sent[q] < len(e) and e[sent[q]] <= credit[q] + 1e-6:
                    assert got[q][sent[q]] == k
                    sent[q] += 1
        assert sent == [len(e) for e in ends]


def test_encoder_equals_the_library(library):
    odd = ["", "a", "É É", "it's don't 12ab,., <|endoftext|> x", "a\x1cb", "a\x85b c", "b\xa0c", "x y　z", "Σας ΣΑΣ Σ", "#### !!'s ''", "\x0b a\x0cb", "İstanbul KelvinK ﬁ", "１２ ab１", "日本語 テスト a日b", "́a b́"]
    odd += ["a≠b a—, —a, ×a÷,a «a»,a ''s a,'s 5's don't, x́,y éÉ,́a1É2,É.É", "a²b ½, №5", "x" * 100, "ab1, " * 200_000, "wörd\n" * 300_000 + "<|endoftext|>"]
    enc = P.WordEncoder(PATH)
    got = [x for _, found in enc.encode_view(TextView(pa.array([*odd, None, *odd]))) for x in found]
    exp = [library(x)[:-1].astype("<u2").tobytes() for x in [*odd, None, *odd]]
    assert got == exp
    enc = P.WordEncoder(PATH)
    enc.MEMO = 5  # a memo that is full keeps what it has, or forgets all
    assert [x for _, found in enc.encode_view(TextView(pa.array(odd))) for x in found] == exp[: len(odd)]


def test_sequences_and_odd_input(spark, library):
    rows = [(1, "a", "one two three"), (2, None, None), (3, "b", ""), (None, "b", "no id"), (5, "", "Word " * 3000), (6, "a", "x")]
    df = spark.createDataFrame(rows, KIND)
    clash = df.selectExpr("*", "1 AS TEXT", "2 AS row", "3 AS queue", "4 AS ids")
    got = P.packed(spark, clash, PATH, length=64, window=100, packet=16, with_ids=True)
    check(got.collect(), [(d, x) for d, _, x in rows], library, 64)
    for s in P.sequences(got).collect():
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == s.length
        for p in s.parts:
            text = next(x for d, _, x in rows if d == p.doc_id)
            assert (ids[p.offset : p.offset + p.length] == library(text)[p.start : p.start + p.length]).all()
    empty = P.packed(spark, df.limit(0), PATH)
    assert empty.count() == 0 and empty.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    same = spark.createDataFrame([(7, x, "same text here") for x in "abcde" for _ in range(10)], KIND)
    assert sum(r.length for r in P.packed(spark, same, PATH, queues=2).collect()) == 50 * len(library("same text here"))
    with pytest.raises(ValueError):
        P.packed(spark, df, PATH, length=100)
