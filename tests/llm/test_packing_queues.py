"""What queue a source has does not depend on how many other sources there are."""

import public_tokenizers

from sparkloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, source string, text string"


def queues(spark, monkeypatch, rows, **options):
    seen, plain = [], P.weights_of
    monkeypatch.setattr(P, "weights_of", lambda sums, targets: seen.append((sums, targets)) or plain(sums, targets))
    pieces = P.packed(spark, spark.createDataFrame(rows, KIND), PATH, **options).collect()
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    return dict(seen[0][0]), seen[0][1]


def test_queues_and_targets_do_not_switch(spark, monkeypatch):
    few = [(i, s, "some words") for i, s in enumerate(["a", "b", None])]
    many = few + [(10 + i, f"s{i}", "x") for i in range(20)]
    options = {"queues": 4, "targets": {"a": 0.5}}
    one, t1 = queues(spark, monkeypatch, few, **options)
    two, t2 = queues(spark, monkeypatch, many, **options)
    assert t1 == t2 and len(t1) == 1 and set(t1) <= set(one)
    assert set(one) <= set(two) and one[None] == two[None] == 3  # the missing source's own queue; 2 tokens and the end
    assert all(one[q] == two[q] for q in t1) and len(two) <= 4 + 2
