"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import spelling as S
from sparkloom.llm.common import TextView
from sparkloom.llm.queries import op12_spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """Exactly one insertion, deletion or replacement, by comparing the two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def brute(rows, all_pairs=True, least=7, times=2, ratio=10, every=31):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if k >= times and len(w) >= least}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    others = {w: [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in others.items() if o}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len({r[0] for r in rows})
    return set(rows)


def test_query_equals_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_spelling_variants(spark, sf)) == brute(rows)


@pytest.mark.parametrize("long", [3, 8, 64])
def test_chains_ties_and_keys_of_both_kinds(spark, long):
    words = {"abcdefgh": 2, "abcdefgx": 20, "abcdefg": 250, "zbcdefg": 3000, "abcdefgy": 20, "aaaaaaaa": 2, "aaaaaaa": 40, "aaaaaaab": 2, "éàbcdefg": 2, "ébcdefg": 30, "èbcdefg": 30, "alonehere": 5, "twotwotwo": 1}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (31, 1 << 40):
        assert got(S.spelling_variants(spark, df, long=long, every=every)) == brute(rows, every=every)


def test_odd_input(spark):
    long = "ab" * 3000
    rows = [(None, "wordwordword wordwordword ×÷ÿabcdef"), (1, None), (2, ""), (3, "Wordwordword, WORDWORDWORE\nwordwordwore"), (3, "short ÉCOLIERS ÉCOLIERS"), (4, f"{long} {long} {long[:-1]} {long[:-1]} {long}x {long}x"), (4, f"{long} {long} {long[:-1]} {long[:-1]} {long}x {long}x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exp = brute(rows)
    assert len(exp) > 4 and got(S.spelling_variants(spark, df)) == exp
    clash = df.selectExpr("doc_id", "text", "1 AS TEXT", "2 AS word", "3 AS n", "4 AS rank")
    assert got(S.spelling_variants(spark, clash)) == exp
    empty = S.spelling_variants(spark, df.limit(0))
    assert empty.count() == 0 and set(empty.columns) == set(COLUMNS)


def test_long_texts_are_cut_between_words():
    text = ("wordwordword " * 50 + "é" * 700 + ", ") * 20
    view = TextView(pa.array(["first one", text, "last"]))
    parts = list(S.pieces(view, 500))
    assert b"".join(d.tobytes() for _, d, _ in parts) == ("first one" + text + "last").encode()
    found = Counter(d[a:z].tobytes().decode() for _, d, o in parts for a, z in zip(*S.letter_runs(d, o)[:2], strict=True))
    assert found == Counter(re.findall("[A-Za-zÀ-ÿ]{7,}", text))
    assert max(len(d) for _, d, _ in parts) < 500 + 1402 + 13 * 50 and isinstance(parts[0][2], np.ndarray)
