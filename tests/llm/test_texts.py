"""Tokenizer operators against their libraries, HTML, URLs, quality, and the pipeline."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe, html_render, quality_crf, token_counts, token_records, url_filter

ODD = ["", None, "a  b", " lead", "trail ", "don't 'tis we're 's", "<|endoftext|> hi <|startoftext|>", "é x  y", "tab\tb\n\n c", "x" * 3000, "中文 字符, ١٢٣ ²", "re.\nOne %%%a &&& b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chunk, overlap", [(64, 8), (300, 40), (32768, 512)])
def test_token_counts_equal_the_library(name, chunk, overlap):
    path = public_tokenizers.path(name)
    texts = [*ODD, " ".join(f"word{i} thing{i % 7}," for i in range(900))]
    whole = [len(token_counts.load(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_column(pa.array(texts, pa.string()), token_counts.Encoder(path), chunk, overlap).tolist() == whole


def test_records_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 5 % 97, t) for i, t in enumerate(ODD * 3)]
    got = sorted(map(tuple, token_records.encode_to_records(spark, spark.createDataFrame(rows, "doc_id long, text string"), path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    tok, at, want = token_records.encoder(path).tok, 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("cuts", [[], [5], [-3, 0, 0, 0, 7, 9, 9, 2**63 - 1], sorted(random.Random(1).choices(range(500), k=1_000))])
def test_places_among_cuts(spark, cuts):
    keys = [-(2**63), -4, -3, -1, 0, 1, 7, 8, 9, 10, 250, 499, 500, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", token_records.below(cuts, F.col("k")).alias("a"), token_records.below(cuts, F.col("k"), or_equal=True).alias("z"))
    assert sorted(map(tuple, rows.collect())) == [(k, bisect.bisect_left(cuts, k), bisect.bisect_right(cuts, k)) for k in keys]


def test_ranges_grow_with_the_table(spark, monkeypatch, tmp_path):
    from sparkloom.llm import common

    spark.range(4_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    few = common.partitions_for(spark, docs)
    monkeypatch.setattr(common, "PART_BYTES", 1 << 12)
    many = common.partitions_for(spark, docs)
    assert many >= 3 * few
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_records.write_records(spark, docs, f"file://{tmp_path}/r", path)
    assert manifest.where("records > 0").count() >= many // 2 and manifest.agg(F.max("records")).first()[0] <= 3 * 4_000 // many
    got = token_records.read_records(spark, manifest, f"file://{tmp_path}/r").orderBy("doc_id").collect()
    at = 0
    for k, r in enumerate(got):
        assert (r["doc_id"], r["start"]) == (k, at)
        at += r["n_tokens"]
    assert len(got) == 4_000


def test_crc32c_and_damage():
    assert token_records.crc32c(b"123456789") == 0xE3069283 and token_records.crc32c(b"") == 0
    record = bytearray(token_records.frames([b"payload" * 100])[0])
    assert token_records.unframe(memoryview(record), [0]) == [b"payload" * 100]
    record[40] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(memoryview(record), [0])


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path).rank, special_tokens={})
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        ids = np.array(e.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids) // 4, byte_bpe.digest(ids), byte_bpe.digest((t or "").encode()))


def test_scan_is_associative():
    rng = np.random.default_rng(1)
    e = rng.integers(0, byte_bpe._SIZE, 1000).astype(np.uint16)
    acc, want = 0, []
    for x in e.tolist():
        want.append(acc)
        acc = int(byte_bpe._MUL[acc, x])
    assert byte_bpe.scan(e).tolist() == want


def test_html():
    got = html_render.extract("<ul><li>a<li>b<ol start=3><li>c</ol></ul><p>x<p hidden>no<div style='display:none'>no</div><style>.q{display:none}</style><b class=q>no</b><table><tr><th>A<th>Bee<tr><td>long<td>1</table>tail<script>no</script>&lt;ok&gt;")
    assert got.split("\n") == ["- a", "- b", "  3. c", "", "x", "", "A     Bee", "long  1", "", "tail<ok>"]
    assert html_render.extract(None) == "" and html_render.extract("<div>" * 20000 + "x") == "x"


def test_url_rules_and_columns(spark):
    urls = ["https://a.ORG/x", "http://x.example.org/es/1?q=/a", "https://example.org/en/19#f", "http://b.com/fr/1", "http://b.com/de/1", "https://c.net", "no scheme", None, "ftp://n.org"]
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    got = {r["page_id"]: r for r in url_filter.url_filter(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 5, 6, 7)] == [("a.org", "/x"), ("c.net", ""), ("", ""), ("", "")]
    assert all(got[i]["verdict"] in ("allow", "block") for i in got)


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((url_filter.Trees().fit(x, y).predict(x) > 0.5) == y).mean() > 0.95


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    u, pair = rng.normal(size=4), rng.normal(size=(2, 2))
    weight = {}
    for s in itertools.product((0, 1), repeat=4):
        weight[s] = np.exp(sum(u[i] for i in range(4) if s[i]) + sum(pair[s[i], s[i + 1]] for i in range(3)))
    total = sum(weight.values())
    want = [sum(w for s, w in weight.items() if s[i]) / total for i in range(4)]
    good, norm, _, _ = quality_crf.forward_backward(u, np.zeros(4, np.int64), pair)
    assert np.allclose(good, want) and np.isclose(norm[0], np.log(total))


def test_quality_is_learnt_and_total(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "\n\n")], "doc_id long, text string")
    out = quality_crf.quality(spark, docs.select("doc_id", "text").unionByName(odd), labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    assert out.score.between(0, 1).all() and len(out) == docs.count() + 3
    held = out[out.held_out & out.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.93
    assert all(quality_crf.remainder(int(i)) == 2 for i in out[out.held_out].doc_id.head(20))


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as C

    from tests.llm.test_exact_and_joins import LOWER

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["decoded_sha256"] for r in C.run(spark, sf).collect()}
    judged = quality_crf.quality(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    bad = set(judged[judged.predicted == 0].doc_id)
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    by = {}
    for i, t in left.items():
        by[t.translate(LOWER)] = max(i, by.get(t.translate(LOWER), -1))
    left = {i: left[i] for i in by.values()}
    assert set(got) <= set(left)
    assert all(d == byte_bpe.digest(left[i].encode()) for i, d in got.items())
    assert len(left) - len(got) < 0.2 * len(left)
