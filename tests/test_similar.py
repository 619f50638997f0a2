"""The Jaccard join by classes against all pairs; copies, short, blank, empty and missing texts."""

import itertools
import random

from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import similar as J
from tests.test_queries import ORACLES  # noqa: F401  registers the queries


def plain(texts):
    grams = {}
    for k, t in texts:
        if t is not None:
            w = t.lower().split(" ")
            grams[k] = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    out = {}
    for a, b in itertools.combinations(sorted(grams), 2):
        c, u = len(grams[a] & grams[b]), len(grams[a] | grams[b])
        if c * 10 >= u * 8:
            out[a, b] = round(c / u, 6)
    return out


def test_all_pairs(spark, tmp_path):
    rng, texts = random.Random(3), ["", "", " ", "  ", None, "a", "A", "a b", "a  b", "a b c", "ä b c d ", " ä b c d", "x\ny z w"]
    for n in (5, 12, 30, 31, 200):
        for _ in range(6):
            base = [rng.choice(["the", "of", *(f"w{i}" for i in range(40))]) for _ in range(n)]
            for changes in (0, 0, 1, 1, n // 20, n // 10):
                t = list(base)
                for _ in range(changes):
                    t[rng.randrange(n)] = rng.choice("pq")
                texts.append(" ".join(t))
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows)
    got = registry.queries()["near_dup_pairs"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want) > 100


def test_copies_are_not_paired_before_the_end(spark):
    """3,000 copies are one class without a link; before, they met in 4.5 million pairs that moved all their grams."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text of some words that is there many times").alias("text"))
    members, links = J.classes(docs, "doc_id", F.lower("text"), 3, 8, 10)
    assert members.select("rep", "copies").distinct().collect() == [(0, 3000)]
    assert links.count() == 0
