"""The kernels of normalised texts give bounded batches, whatever came in one."""

import pyarrow as pa

from sparkloom.functions import text as X

TEXTS = ["a​ﬁx   yyyy 1111", None, "", *["ab cd " * 50_000] * 6]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["doc_id", "text"])


def test_normalised_rows():
    out = list(X.normalised_rows([BATCH]))
    assert len(out) > 1 and all(sum(map(len, b.column("norm").to_pylist())) < X.BATCH_CHARS + 300_001 for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [tuple(r.values()) for r in rows] == [(i, *X.normalise(t or "")) for i, t in enumerate(TEXTS)]


def test_raw_word_rows():
    out = list(X.raw_word_rows([BATCH]))
    assert len(out) > 1 and all(b.num_rows <= X.BATCH_WORDS for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["word"] for r in rows if r["doc_id"] == 0] == X.normalise(TEXTS[0])[0].split()
    assert all(TEXTS[r["doc_id"]][r["raw_start"] : r["raw_end"]] == r["raw"] for r in rows)
    assert [r["k"] for r in rows if r["doc_id"] == 8] == list(range(100_000))
