"""One edit in characters or in bytes."""

import random

import duckdb

from sparkloom import registry
from sparkloom.operators.matching import one_edit
from tests.compare import rows_of


def test_edit1_repair_counts_as_its_sql(spark, tmp_path):
    names, rng = ["anvil", "café", "caféx", "größe", "日本語字", "anvi", "😀bcde"], random.Random(5)
    alphabet = "anvilé ècaföü日本😀😁bcde"
    tokens = {"anviê", "cafè", "cafe", "caféé", "日本誤字", "😁bcde", "bcde"}
    for n in names * 40:
        k = rng.randrange(len(n) + 1)
        tokens.add(n[:k] + rng.choice(["", *alphabet]) + n[k + rng.randrange(2) :])
    spark.createDataFrame([(" ".join(names),)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(sorted(tokens))], "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()["edit1_repair"])
    df = registry.queries()["edit1_repair"](spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_characters_stay_the_default(spark):
    a, b = spark.createDataFrame([("anviê",)], "x string"), spark.createDataFrame([("anvil",)], "y string")
    assert one_edit(a, b, "x", "y").count() == 1
    assert one_edit(a, b, "x", "y", in_bytes=True).count() == 0
