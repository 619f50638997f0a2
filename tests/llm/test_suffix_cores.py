"""Substring dedup: what is exchanged follows the long matches, not the grams that short matches share; any length, periodic texts."""

import random

import numpy as np
import pytest

from sparkloom.llm import suffix_dedup as S


def brute(rows, length):
    first, out = {}, {}
    raw = [(i, t.encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


def run(spark, rows, monkeypatch, folder, hot, length=50):
    """(kept bytes by doc_id, bytes of contexts and strings sent)."""
    shared, contexts, sent = S._shared_grams, S._send_contexts, spark.sparkContext.accumulator(0)
    kinds = (S.OWNERS, S.STRINGS)

    def lowered(batches):  # the workers import the module anew
        S.HOT_CONTEXTS = hot
        yield from shared(batches)

    def counted(*args):
        rows = contexts(*args)

        def send(batches):
            for b in rows(batches):
                sent.add(sum(len(blob) for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True) if kind in kinds))
                yield b

        return send

    monkeypatch.setattr(S, "_shared_grams", lowered)
    monkeypatch.setattr(S, "_send_contexts", counted)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").write.parquet(str(folder))
    got = {x["doc_id"]: bytes(x["kept"]) for x in S.suffix_dedup(spark, spark.read.parquet(str(folder)), length).collect()}
    return got, sent.value


@pytest.mark.parametrize("hot", [20, 100_000])
def test_common_grams_without_long_matches_send_nothing(spark, monkeypatch, tmp_path, hot):
    r = random.Random(3)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    rows = [(i, "".join(noise(20) + "of the same words " for _ in range(10))) for i in range(200)]
    got, sent = run(spark, rows, monkeypatch, tmp_path / "docs", hot)
    assert got == {i: t.encode() for i, t in rows} and sent == 0


def test_lines_that_are_shared_in_part(spark, monkeypatch, tmp_path):
    r = random.Random(4)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    line = noise(44)
    rows = [(i, "".join(noise(r.randint(0, 9)) + line[: r.randint(20, 44)] + r.choice(["x", "yy", noise(7)]) for _ in range(8))) for i in range(120)]
    want = brute(rows, 50)
    assert sum(len(t) for _, t in rows) > sum(map(len, want.values()))
    for hot in (20, 100_000):
        assert run(spark, rows, monkeypatch, tmp_path / f"docs{hot}", hot)[0] == want


@pytest.mark.parametrize("length", [17, 18, 31, 50, 120, 255])
def test_any_length_and_periodic_texts(spark, monkeypatch, tmp_path, length):
    r = random.Random(length)
    passages = ["".join(r.choices("ab ", k=3 * length)) for _ in range(4)] + ["z" * 3 * length, "ab" * 2 * length, "abcdefghijklmnopq" * length]
    rows = [(i, "".join(p[(a := r.randint(0, length)) : a + r.randint(0, 2 * length)] + "-" * r.randint(0, 2) for p in r.choices(passages, k=3))) for i in range(60)]
    want = brute(rows, length)
    for hot in (1, 100_000):
        assert run(spark, rows, monkeypatch, tmp_path / f"docs{hot}", hot, length)[0] == want
