"""Exact dedup, Jaccard join, decontamination and substring dedup against brute force, with the odd cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from sparkloom.llm import suffix_dedup as S
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.exact_dedup import Directory, exact_dedup
from sparkloom.llm.parity_join import jaccard_components
from sparkloom.llm.suffix_dedup import suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, TEXT string, Source string"


def frame(spark, rows):
    """With extra columns whose names clash but for case."""
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)


def shingles(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    passage = r.choices(vocab, k=40)
    out = ["", None, "  ", "A b", "a  B", "one", "É", "é", "x" * 300]
    for _ in range(14):
        base = r.choices(vocab, k=r.choice([3, 5, 8, 20, 60, 150]))
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w + passage * (r.random() < 0.3)))
    out += out[:12]
    return [(i * 7 % 1009 + 1, t) for i, t in enumerate(out)]


def test_exact_dedup(spark):
    rows = corpus(1)
    got = {r["doc_id"]: r for r in exact_dedup(spark, frame(spark, rows), capacity=4, max_depth=8).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        same = [j for j, u in rows if (u or "").translate(LOWER) == (t or "").translate(LOWER)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()


def test_directory_doubles_and_keeps_ranges():
    counts = np.zeros(64, np.int64)
    counts[5] = 100
    counts[40:48] = 3
    d = Directory(counts, 10)
    assert d.depth == 6 and len(d.slots) == 64
    assert all(d.size(b) <= 10 or d.buckets[b][1] == 6 for b in range(len(d.buckets)))
    assert (np.diff(d.owners(4)) >= 0).all()


@pytest.mark.parametrize("seed", [2, 3])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_decontaminate(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(0, 1500)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b")]
    items = [(100, None), (101, ""), (102, "A b")]
    for n in (1, 2, 5, 6, 9, 13, 21, 40, 130):
        for k in range(4):
            w = r.choice([d for d in docs[:40] if len(d[1].split()) > n + 5])[1].split()
            a = r.randrange(len(w) - n)
            items.append((len(items), " ".join(w[a : a + n] if k % 2 else w[a : a + int(n * 0.85)] + r.choices(vocab, k=n - int(n * 0.85)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(spark, frame(spark, docs), bench).collect()}
    want = {(i, k) for i, t in docs for k, u in items if shingles(u) and len(shingles(t) & shingles(u)) * 100 >= 75 * len(shingles(u))}
    assert got == want


def test_splitters_grow_with_the_buckets():
    per_block = 16  # grams that a block samples at least
    for buckets in (8, 5_000, 60_000):
        n = per_block * S.sampled_blocks(buckets)
        raw = random.Random(buckets).randbytes(16 * n)
        grams = np.sort(np.frombuffer(raw, "S16"))
        assert len(S.quantiles(grams, buckets)) == buckets - 1 and n >= 8 * buckets


@pytest.mark.parametrize("bucket_bytes", [32 << 20, 4_000])
def test_suffix_dedup(spark, bucket_bytes, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket_bytes)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 400), (5, "z" * 120), (6, "z" * 49)]
    for i in range(7, 60):
        rows.append((i, " ".join([*(word() for _ in range(r.randint(0, 40))), r.choice(passages)[r.randint(0, 60) :], *(word() for _ in range(r.randint(0, 30)))])))
    rows += [(100, rows[20][1]), (100, rows[21][1]), (101, rows[20][1])]
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        want.append((i, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = [(x["doc_id"], x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), bytes(x["kept"])) for x in suffix_dedup(spark, frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("run", [exact_dedup, jaccard_components, suffix_dedup])
def test_empty_table(spark, run):
    assert run(spark, frame(spark, []).limit(0)).count() == 0


def test_null_ids_do_not_crash(spark):
    rows = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)])
    assert exact_dedup(spark, rows).count() == 3
    assert jaccard_components(spark, rows).count() == 3
    assert suffix_dedup(spark, rows).count() == 3


@pytest.mark.parametrize("hot", [1, 100_000])
def test_suffix_dedup_of_a_gram_with_many_surroundings(spark, monkeypatch, hot, tmp_path):
    """Strings instead of contexts give the same result: the bound is lowered so far that all grams go that way."""
    r = random.Random(7)
    common = "the very same sentence stands in nearly every document of this corpus"
    rows = [(i, "".join(r.choices("abc ", k=r.randint(0, 60))) + common[: r.randint(50, len(common))] + "".join(r.choices("abc ", k=r.randint(0, 60)))) for i in range(60)]
    raw = [(i, t.encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = {}
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        want[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "docs"))  # several blocks
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    monkeypatch.setattr(S, "HOT_CONTEXTS", hot)
    wrapped = S._shared_grams

    def lowered(batches):  # the workers import the module anew
        S.HOT_CONTEXTS = hot
        yield from wrapped(batches)

    monkeypatch.setattr(S, "_shared_grams", lowered)
    got = {x["doc_id"]: bytes(x["kept"]) for x in S.suffix_dedup(spark, spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert got == want


@pytest.mark.parametrize("tile, one_task", [(4, 10**6), (1024, 0), (3, 0)])
def test_jaccard_components_of_a_large_family(spark, tile, one_task):
    """Tiles and distributed components give what brute force gives: near copies in chains, so groups span several components."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(4):
        w = r.choices(vocab, k=40)
        for _ in range(25):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows) * 13 % 1009, " ".join(w)))
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark, frame(spark, rows), tile=tile, one_task=one_task).collect()}
    assert got == {i: find(i) for i in sets}
