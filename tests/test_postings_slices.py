"""A batch of texts is inverted in slices of bounded size, with the same rows."""

from sparkloom.operators import postings as P


def test_slices_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    whole = sorted(map(repr, P.postings(docs, "doc_id").collect()))
    monkeypatch.setattr(P, "SLICE_WORDS", 100)
    assert sorted(map(repr, P.postings(docs, "doc_id").collect())) == whole
