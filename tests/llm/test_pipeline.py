"""The pipeline against a plain version of every stage, and its stages on odd input."""

import re
import zlib

import public_tokenizers
import pytest

import corpus_pipeline as C
from sparkloom.llm import byte_bpe, quality_crf
from tests.llm.test_exact_and_joins import LOWER, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_pipeline(docs, bad, items):
    """{doc_id: text} that is left. docs: {doc_id: text}."""
    left = {i: t for i, t in docs.items() if i not in bad}
    by = {}
    for i, t in left.items():
        key = (t or "").translate(LOWER)
        by[key] = max(i, by.get(key, i))
    left = {i: left[i] for i in by.values()}
    sets, parent, index = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = {}
    for i, s in sets.items():
        for g in s:
            for j in index.setdefault(g, []):
                common[j, i] = common.get((j, i), 0) + 1
            index[g].append(i)
    for (i, j), c in common.items():
        if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    tests = [s for s in map(shingles, items) if s]
    return {i: t for i, t in left.items() if not any(len(sets[i] & s) * 100 >= 75 * len(s) for s in tests)}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_pipeline_equals_a_plain_version(spark, sf, size):
    import tiktoken

    sf = sf.replace("0.001", size)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # the plain version of the trained stage: every document scored by itself, chain by chain, with the model that fit() gives
    model, share = quality_crf.fit(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {i for i, t in texts.items() if score(model, share, t or "") < 0.7}
    left = plain_pipeline(texts, bad, [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).rank, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in C.run(spark, sf).collect()}
    assert got == {i: (len(e.encode_ordinary(t or "")), byte_bpe.digest((t or "").encode())) for i, t in left.items()}


def score(model, share, text):
    """Forward and backward sums over the lines of one text, one line after the other."""
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    x, row, size = quality_crf.line_table(data, np.array([0, len(data)]))
    if model is None or not len(x):
        return share
    u = ((quality_crf.observations(x, row) - model.mean) / model.scale) @ model.weights
    assert [len(y) for y in re.split(b"\n", text.encode()) if y] == size.tolist()
    own = np.stack([np.zeros(len(u)), u], axis=1)
    ahead, back = [own[0]], [np.zeros(2)]
    for k in range(1, len(u)):
        ahead.append(np.logaddexp(ahead[-1][0] + model.pair[0], ahead[-1][1] + model.pair[1]) + own[k])
    for k in range(len(u) - 1, 0, -1):
        back.append(np.logaddexp(model.pair[:, 0] + back[-1][0], model.pair[:, 1] + back[-1][1] + u[k]))
    total = np.array(ahead) + np.array(back[::-1])
    good = 1 / (1 + np.exp(total[:, 0] - total[:, 1]))
    return float((good * size).sum() / size.sum())


@pytest.mark.parametrize("name", [name for name, _ in C.STAGES])
def test_stages_on_odd_input(spark, sf, name):
    stage = dict(C.STAGES)[name]
    rows = [(1, None), (2, ""), (3, "x " * 200_000), (3, "x " * 200_000), (None, "a b"), (None, None), (4, "a")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], COLUMNS + ", TEXT string")
    out = stage(spark, docs, sf)
    if name != C.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.where("doc_id IS NULL").count() == 2 and stage(spark, docs.limit(0), sf).count() == 0


def test_rows_that_repeat_a_doc_id_go_or_stay_together(spark, sf):
    docs = spark.createDataFrame([(5, "a", "", "", 1), (9, "a", "", "", 1), (5, "b", "", "", 1), (7, "c", "", "", 1), (7, "c", "", "", 1)], COLUMNS)
    assert sorted(r["doc_id"] for r in C.drop_exact_copies(spark, docs, sf).collect()) == [7, 7, 9]


def test_marks_of_held_out_rows():
    assert [quality_crf.remainder(i) for i in (1, 22, 333)] == [zlib.crc32(str(i).encode()) % 4 for i in (1, 22, 333)]
