"""The Merkle manifest against plain lists."""

import hashlib
import random
import zlib

import pytest

from sparkloom.llm import merkle as M
from sparkloom.llm.queries import op11_merkle_manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes, f):
    """The levels of nodes up to the one that is left."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + f]) for i in range(0, len(out[-1]), f)])
    return out


def way(levels, i, f):
    """(nodes before, nodes after) in the run, level by level."""
    out = []
    for row in levels[:-1]:
        run = i // f * f
        out.append((row[run:i], row[i + 1 : run + f]))
        i //= f
    return out


def brute(rows, f=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted([r for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]], f) for x in langs}
    over = tree([trees[x][-1][0] for x in langs], f)
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            path = way(trees[x], i, f) + way(over, k, f)
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            for before, after in path:
                digest = h(*before, digest, *after)
            proof = h(*[y for before, after in path for y in before + after])
            out.append((r[0], leaf(r), trees[x][-1][0], over[-1][0], proof, digest, digest == over[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


def test_query_equals_lists(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = got(op11_merkle_manifest(spark, sf))
    assert out == brute(rows)
    assert 0 < sum(not r[-1] for r in out) < len(out)


@pytest.mark.parametrize(("fanout", "block", "together"), [(2, 4, 4), (2, 8192, 2), (3, 10, 9), (5, 30, 40)])
def test_any_fanout_and_blocks(spark, fanout, block, together):
    r = random.Random(fanout)
    sizes = {"a": 1, "b": 2, None: 3, "": 31, "é": 64, "z": 125}
    rows = [(d, r.choice(["s", None]), g, r.choice([None, 7]), r.choice([None, "", "text é"])) for g, n in sizes.items() for d in r.sample(range(-500, 500), n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got(M.document_proofs(spark, df, fanout, block=block, together=together)) == brute(rows, fanout)


def test_odd_input(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(None, None, None, None, None), (None, "s", None, 1, "x"), (7, "s", "en", 3, "x"), (7, "s", "en", 3, "x"), (7, "s", "en", 3, "y"), (8, "", "", 0, "long " * 200000)]
    assert got(M.document_proofs(spark, spark.createDataFrame(rows, kind))) == brute(rows)
    assert got(M.document_proofs(spark, spark.createDataFrame(rows[2:3], kind))) == brute(rows[2:3])
    clash = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS TEXT", "2 AS g", "3 AS pos", "4 AS leaf", "5 AS Lang")
    assert got(M.document_proofs(spark, clash)) == brute(rows)
    empty = M.document_proofs(spark, spark.createDataFrame([], kind))
    assert empty.count() == 0 and set(COLUMNS) == set(empty.columns)


def test_mountain_range_from_any_interval():
    """However the leaves are cut into intervals, their peaks meet in the same top."""
    r = random.Random(1)
    for f in (2, 3, 7):
        for n in (1, 2, 3, 8, 50, 100):
            leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
            cuts = [0, *sorted(r.sample(range(1, n), min(n - 1, 4))), n]
            peaks = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                hill = M.MountainRange(n, f)
                for i in range(a, z):
                    list(hill.push(0, i, leaves[i]))
                peaks += hill.peaks()
            assert len(peaks) <= 5 * 2 * (f - 1) * 8
            hill = M.MountainRange(n, f)
            for p in sorted(peaks, key=lambda p: p[1] * f ** p[0]):
                list(hill.push(*p))
            assert [x[2].hex() for x in hill.peaks()] == tree([x.hex() for x in leaves], f)[-1]
