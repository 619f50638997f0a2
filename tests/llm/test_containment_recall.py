"""Recall of the containment search by item size, at the threshold itself, where the MinHash search has least to go by."""

import random
from collections import Counter

import pytest

from sparkloom.llm.decontaminate import contaminated

SIZES = (1, 4, 8, 9, 12, 16, 17, 24, 33, 64, 65, 200, 1_000)
ITEMS = 60


@pytest.mark.parametrize("pieces", [1, 3])
def test_recall_by_item_size(spark, pieces):
    rng = random.Random(pieces)
    words = lambda n: [f"w{rng.randrange(60_000)}" for _ in range(n)]
    items, docs, size = [], [], {}
    for n in SIZES:
        for _ in range(ITEMS):
            k, item = len(items), words(n + 4)
            items.append((k, " ".join(item)))
            size[k] = n
            need = -(-75 * n // 100)
            for doc, common in ((2 * k, need), (2 * k + 1, need - 1)):  # one document at the threshold, one a shingle below it
                # pieces far apart: each gives its length less 4 shingles
                cuts = [common * p // pieces for p in range(pieces + 1)]
                text = words(rng.randint(200, 900))
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if z > a:
                        text += item[a : z + 4] + words(400)
                docs.append((doc, " ".join(text)))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = Counter(size[i] for d, i in got if d == 2 * i)
    assert {n: found[n] / ITEMS for n in SIZES} == dict.fromkeys(SIZES, 1.0)
    assert all(d == 2 * i and c == -(-75 * n // 100) for (d, i), (n, c) in got.items())
