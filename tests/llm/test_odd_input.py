"""Every operator and pipeline stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import byte_bpe, decontaminate, exact_dedup, parity_join, quality_crf, suffix_dedup, token_counts, token_records, url_filter

LONG = "several words of a very long text, " * 30_000  # a megabyte
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "a b"), (None, None), (4, LONG), (5, LONG), (6, "x" * 300_000), (7, "\n\n"), (2**63 - 1, "z " * 40), (-(2**63), "z " * 40)]
BPE, JSON, WORD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, TEXT string, Doc_Id long")


def labels(spark):
    return spark.createDataFrame([(1, 1, None), (3, 0, None), (3, None, None), (4, 1, "x"), (6, 0, "x"), (None, 1, "x"), (7, 9, "x")], "doc_id long, quality int, QUALITY string")


def items(spark):
    return spark.createDataFrame([(1, "ONE two three four five", "x"), (1, "ONE two three four five", "x"), (2, None, "x"), (3, "", "x"), (None, "a B", "x")], "item_id long, text string, Text string")


RUNS = {
    "op1": lambda s, d: exact_dedup.exact_dedup(s, d),
    "op3": lambda s, d: token_counts.token_counts(d, WORD),
    "op5": lambda s, d: quality_crf.quality(s, d, labels(s)),
    "op6": lambda s, d: parity_join.jaccard_components(s, d),
    "op7": lambda s, d: decontaminate.contaminated(s, d, items(s)),
    "op8": lambda s, d: token_records.encode_to_records(s, d, JSON),
    "op9": lambda s, d: byte_bpe.round_trip(d, BPE),
    "op10": lambda s, d: suffix_dedup.suffix_dedup(s, d),
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: [r.asDict() for r in run(spark, frame(spark)).collect()] for name, run in RUNS.items()}


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    assert RUNS[name](spark, frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", set(RUNS) - {"op7"})
def test_a_row_for_each_row(results, name):
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in results[name])
    assert ids == sorted((i is None, i or 0) for i, _ in ROWS)


def text_of(r):
    return [t or "" for i, t in ROWS if i == r["doc_id"]]


def test_exact(results):
    for r in results["op1"]:
        if r["doc_id"] is not None:
            t = text_of(r)[0]
            same = [i for i, u in ROWS if (u or "") == t]
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(i for i in same if i is not None), len(same), hashlib.sha256(t.encode()).hexdigest())


def test_counts_and_bytes(results):
    import tiktoken

    tok = token_counts.load(WORD)
    merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(BPE).rank, special_tokens={})
    for r in results["op3"]:
        assert (r["n_bytes"], r["n_tokens"]) in {(len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for t in text_of(r)}
    for r in results["op9"]:
        if r["doc_id"] != 6:  # the library takes too long for one word of 300,000 letters
            assert r["n_tokens"] in {len(merge.encode_ordinary(t)) for t in text_of(r)}
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in text_of(r)}


def test_records(results):
    tok, at = token_records.encoder(JSON).tok, 0
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])
    for r in sorted(results["op8"], key=order):
        assert r["start"] == at
        at += r["n_tokens"]
        whole = [np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in text_of(r)]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(x.tobytes())) for x in whole}


def test_scores(results):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in results["op5"])
    assert len({r["score"] for r in results["op5"] if r["doc_id"] in (2, 3, 7)}) == 1  # texts without lines


def test_components(results):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in results["op6"]}
    low = -(2**63)
    assert found == {(1, 2, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (None, 0, None), (4, 7, 4), (5, 7, 4), (6, 1, 6), (7, 0, 7), (2**63 - 1, 1, low), (low, 1, low)}


def test_leaks(results):
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["n_common"]) for r in results["op7"]) == [(0, 0, 1), *[(1, 1, 1)] * 4]


def test_substrings(results):
    for r in results["op10"]:
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert r["n_bytes"] in {len(t.encode()) for t in text_of(r)} and len(r["kept"]) == r["n_bytes"] - removed
        assert removed == {5: len(LONG), 2**63 - 1: 80}.get(r["doc_id"], 0)


def test_many_rows_of_one_id(spark, tmp_path):
    """A doc_id that fills several ranges is dealt over several tasks; starts stay without gaps and damage is noticed."""
    rows = [(5, f"text {i}") for i in range(400)] + [(9, "z"), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_records.write_records(spark, docs, f"file://{tmp_path}/r", JSON, tasks=6, shard_bytes=500)
    got = sorted(token_records.read_records(spark, manifest, f"file://{tmp_path}/r").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1] + [5] * 400 + [9]
    assert [r["start"] for r in got[1:]] == list(np.cumsum([r["n_tokens"] for r in got])[:-1])
    shards = [r["shard"] for r in manifest.collect()]
    assert len({s.split("-")[0] for s in shards}) > 3 and len(shards) > 6
    index = token_records.read_index(f"file://{tmp_path}/r", shards[0])
    back = list(token_records.read_ids(f"file://{tmp_path}/r", shards[0]))
    some = np.arange(index.shape[1])[::-1]
    assert [(d, x.tolist()) for d, x in token_records.read_ids(f"file://{tmp_path}/r", shards[0], some)] == [(d, x.tolist()) for d, x in back[::-1]]


def test_offsets_of_slices(spark):
    texts = ["it's  a 12 test, é!\n", "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = byte_bpe.ranks(BPE)
    for r in byte_bpe.encode(docs, BPE, with_offsets=True).collect():
        raw, starts, sizes = texts[r["doc_id"]].encode(), np.frombuffer(bytes(r["starts"]), "<u4"), np.frombuffer(bytes(r["slice_ids"]), "<u4")
        ids, at = np.frombuffer(bytes(r["ids"]), "<u4"), 0
        for a, z, n in zip(starts, [*starts[1:], len(raw)][: len(starts)], sizes, strict=True):
            assert vocabulary.decode(ids[at : at + n]) == raw[a:z]
            at += n
        assert at == len(ids)


def test_urls(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block")]
    rows = [(1, "http://a.org/x", "c"), (1, "http://a.org/x", "c"), (None, "http://example.org/es/1", "c"), (2, None, "c"), (3, "", "c"), (4, "http://b.net/" + "x" * 1_000_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, URL string")
    got = sorted((r["page_id"] or 0, r["host"], r["rule"] or "") for r in url_filter.url_filter(spark, pages, rules).collect())
    assert got == [(0, "example.org", "example.org/es/"), (1, "a.org", "org/"), (1, "a.org", "org/"), (2, "", ""), (3, "", ""), (4, "b.net", "")]
    assert url_filter.url_filter(spark, pages.limit(0), rules).count() == 0


def test_urls_equal_brute_force(spark, sf):
    """Host, path, rule and its verdict of every page by plain string operations."""
    from sparkloom.llm.queries import URL_RULES, op2_url_filter

    sf = sf.replace("0.001", "0.01")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op2_url_filter(spark, sf).collect():
        url = urls[r["page_id"]] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].partition("#")[0].partition("?")[0]
        fits = [(len(k), k, says) for k, says in URL_RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.partition("/")[2])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert r["verdict"] == max(fits)[2]


def test_trees_judge_urls_that_no_rule_fits(spark):
    """Labelled urls of one look are blocked and of another allowed; urls of both looks on hosts without a rule follow."""
    import random

    r = random.Random(5)
    bad = lambda: f"/{r.randint(10**5, 10**9)}/x{r.randint(0, 10**6)}.php?id={r.randint(1, 10**6)}&ref={r.randint(1, 99)}"
    good = lambda: "/" + "/".join(r.choice(["news", "about", "garden", "recipes", "travel"]) for _ in range(r.randint(1, 3))) + r.choice(["", "/2024", "?page=2"])
    rows = [(i, f"https://{'spam' if i % 2 else 'fine'}.test{bad() if i % 2 else good()}") for i in range(600)]
    rows += [(1000 + i, f"https://h{i}.net{bad() if i % 2 else good()}") for i in range(400)]
    out = url_filter.url_filter(spark, spark.createDataFrame(rows, "page_id long, url string"), [("spam.test/", "block"), ("fine.test/", "allow")]).where("page_id >= 1000").collect()
    assert all(x["rule"] is None for x in out) and np.mean([(x["verdict"] == "block") == (x["page_id"] % 2 == 1) for x in out]) > 0.97
