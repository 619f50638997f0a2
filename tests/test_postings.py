"""The positional index and cover density against plain lists of words."""

import random
import re
import time

from pyspark.sql import functions as F

from sparkloom.operators import postings as P


def naive(text, terms, span):
    """matched, tf, covers: covers are all runs that hold the matched terms and have no smaller such run inside."""
    w = [x for x in re.split(r"[^a-z0-9é]+", text.lower()) if x]
    at = {t: [i for i, x in enumerate(w) if x.startswith(t)] for t in terms}
    at = {t: x for t, x in at.items() if x}
    if not at:
        return None
    ends = sorted({i for x in at.values() for i in x})
    runs = [(a, z) for a in ends for z in ends if a <= z and all(any(a <= i <= z for i in x) for x in at.values())]
    covers = [r for r in runs if not any(q != r and r[0] <= q[0] and q[1] <= r[1] for q in runs)]
    return len(at), sum(map(len, at.values())), sum(1_000_000 if z - a < span else span * 1_000_000 // (z - a + 1) for a, z in covers)


def test_cover_density_equals_its_definition(spark, tmp_path):
    r = random.Random(3)
    vocab = ["alpha", "alps", "beta", "bet", "gamma", "élan", "x1", "other", "word"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 40, 120])))) for i in range(60)] + [(60, None), (61, "Alpha, ALPHA-beta; élan")]
    df = spark.createDataFrame(docs, "id long, text string")
    P.write_index(df, "id", str(tmp_path / "i"), parts=3)
    index = spark.read.parquet(str(tmp_path / "i"))
    for terms in (["al", "bet"], ["alp", "al", "gam", "él"], ["zzz"], ["a"], []):
        for span in (1, 3, 16):
            got = {x.id: (x.matched, x.tf, x.covers) for x in P.scores(index, "id", terms, span).collect()}
            want = {i: naive(t or "", terms, span) for i, t in docs}
            assert got == {i: x for i, x in want.items() if x}


def test_only_the_terms_postings_are_read(spark, sf):
    index = P.index_of(spark, spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    plan = P.found(index, ["ther", "ration"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,ther)" in plan and "PartitionFilters: [((lead" in plan
    one = index.where("word = 'the'").agg(F.sum(F.size("places"))).first()[0]
    texts = [r.text.lower() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert one == sum(re.split(r"[\W_]+", t).count("the") for t in texts)


def test_index_is_kept_until_the_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "first words")], "id long, text string").coalesce(1).write.parquet(path)
    ask = lambda t: [r.id for r in P.scores(P.index_of(spark, spark.read.parquet(path), "id"), "id", [t]).collect()]
    files = lambda: sorted(P.index_of(spark, spark.read.parquet(path), "id").inputFiles())
    assert ask("fir") == [1] and files() == files()
    time.sleep(0.01)
    spark.createDataFrame([(2, "second words")], "id long, text string").coalesce(1).write.mode("append").parquet(path)
    assert sorted(ask("word")) == [1, 2] and ask("sec") == [2]
