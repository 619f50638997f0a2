"""Sentences keep their characters and lose their blanks; the queries equal their SQL on odd texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import text as X
from tests.compare import rows_of

ODD = ["Zero. 1 one. 22 two. 3333 three. 4 four 4.", "a.\n  b \n c .  d　\n ", "", "  \n ", " ", None, "x", "1\n1\n1", ".\t\n\ty\t"]


def test_sentences_are_not_trimmed_of_their_number(spark):
    d = spark.createDataFrame([("0 a. 1 b. 2 c 2.\n 3d ",)], "t string")
    assert d.select(X.sentences(F.col("t"))).first()[0] == ["0 a.", "1 b.", "2 c 2.", "3d"]


@pytest.mark.parametrize("name", ["sentence_stats", "sentence_split"])
def test_queries_on_odd_texts(spark, tmp_path, name):
    rows = list(enumerate(ODD))
    spark.createDataFrame([(k, t, "en", "src0") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, t) for k, t in rows], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())
