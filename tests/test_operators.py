"""Edge laws of single operators on literal frames."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import analytics as A
from sparkloom.operators import governance as G
from sparkloom.operators import judge as J
from sparkloom.operators import matching as D
from sparkloom.operators import metrics as M
from sparkloom.operators import outline as O
from sparkloom.operators import retrieval as R
from sparkloom.operators import splits as S
from sparkloom.sources import files


def test_fuse_keeps_rows_of_one_branch_and_breaks_ties_by_id(spark):
    left, right = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank_l int"), spark.createDataFrame([(3, 1), (2, 2)], "id int, rank_r int")
    got = {r["id"]: r["rrf"] for r in R.fuse(left, right, "id").collect()}
    assert got[1] == got[3] == round(1 / 61, 9) and got[2] == round(2 / 62, 9)
    order = [r["id"] for r in R.ranked(R.fuse(left, right, "id").select("id", "rrf"), [F.desc("rrf"), F.asc("id")], "r").orderBy("r").collect()]
    assert order == [2, 1, 3]


def test_filter_then_fuse_differs_from_fuse_then_filter(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "b", 3)], "id int, law string, score int")
    view = R.law_view(rows, rows, "id", F.col("law") == "b", [F.asc("score")], [F.asc("score")]).collect()
    assert {r["id"]: r["rank_l"] for r in view} == {2: 1, 3: 2}


def test_query_of_function_words_has_no_terms(spark):
    df = spark.createDataFrame([("the and of",), ("walking the walked",)], "q string").select(R.query_terms(F.col("q")).alias("t"))
    assert [r["t"] for r in df.collect()] == [[], ["walk"]]
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert R.lexical_scores(docs, []).count() == 0


def test_diversify_demotes_stably(spark):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate("aaabab")], "i int, g string")
    assert [r["i"] for r in R.diversify(rows, "g", [F.asc("i")]).orderBy("place").collect()] == [0, 1, 3, 5, 2, 4]


def test_unknown_floor_is_not_the_lowest(spark):
    rules = spark.createDataFrame([("L", "T", None, "all", 2, False)], "law string, type string, code string, cover string, risk int, family boolean")
    hits = spark.createDataFrame([(1, "L", "T", "a", False), (2, "M", "T", "a", False), (3, "M", "U", "a", True)], "id int, law string, type string, code string, sub_items boolean")
    got = {r["id"]: r["floor"] for r in J.floors(hits, rules, ["law", "type"], "code").collect()}
    assert got == {1: 2, 2: None, 3: None}
    empty = J.floors(hits, rules.limit(0), ["law", "type"], "code").collect()
    assert all(r["floor"] is None for r in empty)


def test_ratchet_is_null_only_without_both(spark):
    df = spark.createDataFrame([(2, None), (None, 3), (None, None), (0, 3)], "f int, e int").select(J.ratchet(F.col("f"), F.col("e")).alias("r"))
    assert [r["r"] for r in df.collect()] == [2, 1, None, 1]


def test_branches_that_differ_are_held(spark):
    rows = [(1, "confirmed", ["x"], 1), (1, "confirmed", ["x"], 2), (2, "confirmed", ["x"], 1), (2, "hold", [], 0), (3, "hold", [], 0)]
    got = {r["s"]: (r["record"], r["risk"]) for r in J.recorded(spark.createDataFrame(rows, "s int, verdict string, violations array<string>, risk int"), "s").collect()}
    assert got == {1: ("confirmed", 2), 2: ("hold", 1), 3: ("unchanged", None)}


def test_kappa_of_constant_annotators_is_undefined(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert M.kappa(df, "a", "b").first()["kappa"] is None


def test_wilson_of_nothing_has_no_interval(spark):
    lo, hi = M.wilson(F.lit(0), F.nullif(F.lit(0), F.lit(0)))
    assert tuple(spark.range(1).select(lo, hi).first()) == (None, None)


def test_empty_declaration_never_sweeps(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        G.orphans(df, df.limit(0), ["k"])


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = G.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, G.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_editions_need_leave_and_the_original_wins(spark):
    df = spark.createDataFrame([("a",), ("a__c20240101",), ("b__c20240101",), ("b__c20240202",)], "path string")
    with pytest.raises(ValueError):
        files.editions(df)
    assert sorted(r["path"] for r in files.editions(df, allow=True).collect()) == ["a", "b__c20240101"]


def test_unknown_value_of_an_optional_set_raises():
    with pytest.raises(ValueError):
        G.optional_set(F.lit("a"), ["z"], ["a"])


def test_offsets_of_repeated_sentences_do_not_overlap():
    assert X.offsets_of("ab. ab. ab.", ["ab.", "ab.", "ab."]) == [0, 4, 8]
    with pytest.raises(ValueError):
        X.offsets_of("ab", ["ab", "ab"])


def test_normalise_maps_back_over_expanded_characters():
    norm, offsets, fired = X.normalise("a​ﬁx   yyyy 1111")
    assert norm == "afix yy 1111" and fired == ["invisible", "width", "repeat", "space"]
    assert len(norm) == len(offsets) and offsets == sorted(offsets)
    assert X.to_raw(offsets, 17, 1, 2) == (2, 3)  # one half of the ligature is the whole raw character


@pytest.mark.parametrize(
    "text, spans",
    [
        ('it\'s "one two" and "three\nfour" "five"', ["one two", "five"]),
        ("“a  b” 'c' «d e» “f”", ["a b", "f", "c", "d e"]),  # family by family
        ("\"a' b\" 'x\" y'", ["a' b", 'x" y']),  # another family's mark closes nothing
        ('"open "again" end', ["again"]),  # a mark behind a blank starts anew
        ('say "x"y" z', ["x"]),  # a mark behind a letter opens nothing
        ('"" "a""b"', ["a", "b"]),
        ("", []),
    ],
)
def test_quotes(spark, text, spans):
    assert spark.createDataFrame([(text,)], "t string").select(X.quoted(F.col("t"))).first()[0] == spans


def test_quote_lengths_and_families(spark):
    df = spark.createDataFrame([('"abc" \'de\' "f"',)], "t string")
    assert df.select(X.quoted(F.col("t"), least=2, most=2)).first()[0] == ["de"]
    assert df.select(X.quoted(F.col("t"), families=["'"])).first()[0] == ["de"]


def test_raw_spans_of_normalised_words(spark, sf):
    from sparkloom import registry

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = {i: [] for i in texts}
    for r in registry.queries()["offset_roundtrip"](spark, sf).orderBy("doc_id", "k").collect():
        text = texts[r["doc_id"]]
        assert r["raw"] == text[r["raw_start"] : r["raw_end"]]
        assert X.normalise(r["raw"])[0].strip() == r["word"]
        words[r["doc_id"]].append((r["word"], r["raw_start"], r["raw_end"]))
    for i, found in words.items():
        assert [w for w, _, _ in found] == X.normalise(texts[i] or "")[0].split()
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_raw_span_at_the_end_and_of_nothing():
    _, offsets, _ = X.normalise("aﬁ\u200b")
    assert X.to_raw(offsets, 3, 1, 3) == (1, 3) and X.to_raw(offsets, 3, 0, 1) == (0, 1)
    assert X.to_raw(offsets, 3, 2, 2) == (1, 1) and X.to_raw(offsets, 3, 3, 3) == (3, 3)


def test_hard_cut_counts_its_pieces(spark):
    texts = ["", "a", "é" * 700, "x\n" * 350 + "😀", "y" * 1401]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.hard_cut(F.col("t")).alias("c"), X.piece_count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["c"] == [r["t"][k : k + 700] for k in range(0, max(1, len(r["t"])), 700)] and r["n"] == len(r["c"])


def test_admissible_span_of_short_terms():
    assert D.admissible_span("no ab", "oa") is None  # starts inside a word and runs over a blank
    assert D.admissible_span("o ab", "oa") == (0, 3)
    assert D.admissible_span("many long words", "long") == (5, 9)


def test_copy_sentences_equal_a_plain_scan(spark):
    import random
    import time

    marks = ".!?\u3002\uff01\uff1f\u2026\u2600\u27bf\u2b50\ufe0f\u200d\U0001f000\U0001faff"
    rng = random.Random(3)
    texts = [None, "", " \u3000", "\n", "3.5g of it", "now #a#b # c", "a \U0001f600\ufe0f b\u2728c", "x\r\n\r\n#y", "same. same.  same."]
    texts += ["".join(rng.choices("ab#\n \u3000\u00a0\x1f\u2600" + marks, k=rng.randint(1, 30))) for _ in range(600)]

    def plain(t):
        out, own, k = [], "", 0
        while k < len(t):
            end = k
            while end < len(t) and t[end].isspace():
                end += 1
            tag = end + 1 < len(t) and t[end] == "#" and not t[end + 1].isspace()
            if end > k and ("\n" in t[k:end] or tag or k and t[k - 1] in marks):
                # a line feed within the white space: what is around it is trimmed either way
                out.append(own)
                own = ""
            else:
                own += t[k:end]
            if end < len(t):
                own += t[end]
            k = end + 1
        return [p.strip() for p in [*out, own] if p.strip()] or [t]

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", X.copy_sentences(F.col("t")).alias("s")).collect():
        assert r.s == (None if texts[r.k] is None else plain(texts[r.k])), repr(texts[r.k])
    long = spark.createDataFrame([(" " * 500_000 + "x" + "\u3000 " * 500_000 + "#y",)], "t string")
    start = time.monotonic()
    assert long.select(X.copy_sentences(F.col("t")).alias("s")).first().s == ["x", "#y"] and time.monotonic() - start < 20


def test_sentences_never_empty(spark):
    df = spark.createDataFrame([("One. Two! three",), ("",), ("   ",)], "t string").select(X.sentences(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [["One.", "Two!", "three"], [""], ["   "]]


def test_pack_chunks_bounds(spark):
    text = ("abc def. " * 300).strip()
    got = spark.createDataFrame([(text,), ("x" * 1500,), ("short",)], "t string").select(X.pack_chunks(F.col("t")).alias("c")).collect()
    assert all(len(c) <= 700 for r in got for c in r["c"]) and got[1]["c"] == ["x" * 700, "x" * 700, "x" * 100] and got[2]["c"] == ["short"]


def test_hash_slot_equals_the_integer_remainder(spark):
    import hashlib

    keys = [f"k{i}" for i in range(200)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.hash_slot(F.col("k")).alias("s")).collect()}
    for k in keys:
        r = int(hashlib.sha256(f"v1|{k}".encode()).hexdigest(), 16) % 10
        assert got[k] == ("train" if r < 5 else "dev" if r < 7 else "sealed")


def test_components_do_not_depend_on_row_order(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 6)]
    one = {tuple(r) for r in D.min_label_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    two = {tuple(r) for r in D.min_label_components(spark, spark.createDataFrame(edges[::-1], "a long, b long")).collect()}
    assert one == two == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5)}


def test_page_beyond_the_last_is_clamped(spark):
    got = A.page(spark.range(95), [F.asc("id")], 99, 20).collect()
    assert [r["id"] for r in got] == list(range(80, 95)) and got[0]["page"] == 5


def test_duplicates_that_make_up_the_total_are_not_complete(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "page int, v string")
    assert files.page_completeness(df, "page", F.lit(2)).first()["complete"] is False


def test_outline_renumbering_starts_a_section():
    got = O.outline("1. a\n(1) b\nmore\n(2) c\n- d\n- e\n1. again")
    assert [x[4] for x in got] == ["1", "1.1", "1.2", "1.2.-1", "1.2.-2", "1"] and got[1][5] == "b more" and got[-1][1] == got[0][1] + 1


def test_box_rows_join_lines_of_a_row():
    got = files.box_rows("+--+--+\n| ab | 1 |\n| cd | 2 |\n+--+--+\n| x | y |\n+--+--+")
    assert got == [(["abcd", "12"], False), (["x", "y"], False)]


def test_place_phrases_by_clause_and_document(spark):
    from sparkloom.operators import judge as J

    clauses = spark.createDataFrame([(1, "violation", "says it\ncures all"), (1, "lawful", "tastes good, cures all"), (1, "document", "a closing part"), (2, "dropped", "hidden ad"), (3, "document", "plain")], "doc int, disposition string, text string")
    phrases = spark.createDataFrame([(1, "cures all"), (1, "tastes  good"), (1, "closing"), (1, "nowhere"), (1, ""), (2, "ad"), (2, "hidden ad"), (3, "plain"), (4, "no clauses"), (2, "ad")], "doc int, phrase string")
    got = {(r.doc, r.phrase): r.place for r in J.place_phrases(clauses, phrases, "doc", "text", "phrase").collect()}
    v, w, x = J.PLACES
    assert got == {(1, "cures all"): v, (1, "tastes  good"): w, (1, "closing"): v, (1, "nowhere"): v, (1, ""): v, (2, "ad"): x, (2, "hidden ad"): x, (3, "plain"): v, (4, "no clauses"): v}


def test_every_contract_rule_breaks_and_holds(spark, sf):
    from sparkloom import registry
    from sparkloom.operators import judge as J

    q = registry.queries()
    counts = {r.rule_id: r["count"] for r in q["sentence_contract"](spark, "/root/testdata/sf0.01").groupBy("rule_id").count().collect()}
    total = q["verdict_cascade"](spark, "/root/testdata/sf0.01").count()
    assert set(counts) == set(J.sentence_contract()) and max(counts.values()) < total
