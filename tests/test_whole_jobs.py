"""Queries on small tables whose rows lie where a cut once was."""

import datetime

import pytest

from sparkloom import registry
from tests.compare import connect, rows_of

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture
def made(spark, tmp_path):
    """Writes a table below a folder of its own and gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_every_event_has_its_latest_neighbours(spark, sf, made):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 1 + i % 3 * 30, start + datetime.timedelta(hours=i % 17), ("error", "view", None)[i % 7 % 3]) for i in range(1, 150)]
    d = made("events", rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    got = sorted(map(tuple, QUERIES["nullsafe_same_place"](spark, d).collect()))
    place = lambda r: (r[1], None if r[3] == "error" else r[3])
    want = []
    for a in rows:
        others = sorted((r for r in rows if place(r) == place(a) and r[0] != a[0]), key=lambda r: (r[2], r[0]), reverse=True)
        want += [(a[0], b[0]) for b in others[:10]]
    assert got == sorted(want) and any(a > 20 and a % 50 for a, _ in got)


def test_paths_of_late_orders_are_repaired(spark, made):
    d = made("lineitem", [(k, n) for k in (1, 1999, 2000, 10**9) for n in range(1, 5)], "l_orderkey long, l_linenumber int")
    got = {(r["doc"], r["seq"]): r["unique_path"] for r in QUERIES["path_repair"](spark, d).collect()}
    assert got == {(k, n): ("1.1~1", "1.2", "1.0", "1.1~2")[n - 1] for k in (1, 1999, 2000, 10**9) for n in range(1, 5)}


def test_late_orders_have_an_effective_date(spark, made):
    day = lambda y: datetime.datetime(y, 6, 1)
    rows = [(k, day(y)) for k in (12, 5000, 5001, 10**9) for y in (1995, 1996)]
    d = made("orders", rows, "o_orderkey long, o_orderdate timestamp_ntz")
    got = sorted(map(tuple, QUERIES["effective_date_split"](spark, d).collect()))
    assert got == sorted((k, t > day(1995)) for k, t in rows)


def test_claims_behind_a_long_beginning_are_split(spark, made):
    from sparkloom.functions.text import split_claims

    text = ", ".join(f"claim number {k} holds" for k in range(40))
    d = made("benchmark", [(1, text)], "item_id long, text string")
    got = [r["claim"] for r in QUERIES["claim_split"](spark, d).orderBy("k").collect()]
    assert got == split_claims(text.replace(",", "·")) and got[-1].endswith("claim number 39 holds")


def test_all_cells_of_a_url_are_parsed(spark, made):
    url = "https://example.org/" + "/".join(f"part{k}" for k in range(30))
    d = made("pages", [(1, url)], "page_id long, url string")
    got = QUERIES["table_parse"](spark, d).orderBy("row_no").collect()
    assert [r["cells"] for r in got] == [["kind", "n"], url.split("/")]


def test_large_dictionaries_find_what_small_ones_do(spark, monkeypatch):
    from sparkloom.operators import automaton
    from sparkloom.operators import matching as D

    docs = spark.createDataFrame([(1, "Something, else."), (2, "ABCD thing."), (3, None), (4, ""), (5, "ab cd ab cd"), (5, "ab cd ab cd"), (6, "x"), (7, "é" * 254 + "a b c d" + "é" * 600 + "x")], "i int, text string")
    terms = spark.createDataFrame([("thing", 1), ("ab cd", 2), ("abcd", 3), ("x", 4), ("Some thing, else", 5), ("thinner", 6), ("g", 7), (None, 8), ("", 9), ("x", 10)], "term string, k int")
    small = sorted(map(tuple, D.dictionary_hits(docs, terms).collect()), key=repr)
    blocks = automaton.term_blocks
    for block, most in ((5, 100), (5, 0)):  # several blocks; none, so that terms meet the texts on their first characters
        monkeypatch.setattr(automaton, "term_blocks", lambda d, t, b=block, m=most, *_: blocks(d, t, b, m))
        large = D.dictionary_hits(docs, terms)
        assert sorted(map(tuple, large.collect()), key=repr) == small and large.columns == D.dictionary_hits(docs, terms.limit(1)).columns
    assert {(2, "thing", 1, 5), (1, "thing", 1, 5), (2, "ab cd", 2, 1)} <= {(r[0], r[2], r[3], r[4]) for r in small}


def test_claims_meet_every_official_name(spark, made):
    long = "y" * 45
    rows = [(k, f"name {k:04d}") for k in range(600)] + [(600, f"{long} one"), (601, f"{long} two")]
    d = made("part", rows, "p_partkey long, p_name string")
    got = {r["claim_id"]: (r["kind"], r["name"]) for r in QUERIES["claim_nearest"](spark, d).collect()}
    assert got == {k: ("core", name) for k, name in rows}


def test_best_claim_equals_all_pairs(spark):
    import random

    from sparkloom.operators.matching import best_claim

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(7)
    names = sorted({"".join(r.choices("abcD ", k=r.choice([6, 11, 18, 33]))) for _ in range(120)} | {""})
    claims = [None, "", " "]
    for n in names:
        c = list(n)
        for _ in range(r.randint(0, 1 + len(n) // 4)):
            at = r.randrange(len(c) + 1)
            c[at : at + r.randint(0, 1)] = r.choice(["", "x", "a", "bc"])
        claims.append("".join(c))
    names.remove("")
    norm = lambda s: s.lower().replace(" ", "")
    names = [n for n in names if norm(n)]
    want, kinds = {}, ["", "near", "contained", "contains", "core", "exact"]
    for k, c in enumerate(claims):
        best = None
        for n in names if c is not None else []:
            x, y = norm(c), norm(n)
            ratio = 1 - edits(x, y) / max(len(x), len(y), 1)
            rank = 5 if c == n else 4 if x == y else 3 if y in x else 2 if x in y else 1 if ratio >= 0.8 else 0
            best = max(best or (0,), (rank, round(ratio, 6), n)) if rank else best
        want[k] = (kinds[best[0]], best[2], best[1]) if best else ("none", None, None)
    got = {x["claim_id"]: (x["kind"], x["name"], x["ratio"]) for x in best_claim(spark.createDataFrame(list(enumerate(claims)), "claim_id int, claim string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_candidates_are_held_against_accepted_whole_texts(spark, made):
    start, end = "the very same beginning of ", " and the words that end this candidate text"
    texts = [
        (start + "one tale about ships", None), (start + "quite another report, on cooking and on gardens", None),  # alike for 20 characters only
        ("now " + start + "one tale about ships", "duplicate"), (start + "one tale about ships", "duplicate"), (start.upper() + "one tale about  ships", "duplicate"),
        ("a number 1234" + end, "number"), ("a number one" + end, None),  # the rejected one does not count
        ("short", "short"), ("short", "short"), (None, None), (None, "duplicate"),
    ]
    d = made("conversations", [(c, k, t) for c in (1, 2) for k, (t, _) in enumerate(texts)] + [(3, 0, texts[2][0])], "conv_id long, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r["reason"] for r in QUERIES["candidate_filter"](spark, d).collect()}
    assert got == {(c, k): why for c in (1, 2) for k, (_, why) in enumerate(texts)} | {(3, 0): None}
    again = {r["conv_id"]: (r["kept"], r["state"]) for r in QUERIES["retry_loop"](spark, d).collect()}
    assert again == {1: (3, "ok"), 2: (3, "ok"), 3: (1, "search_failed")}


def test_many_terms_give_what_few_give(spark):
    from pyspark.sql import functions as F

    from sparkloom.operators.matching import contained

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["deepwater", "spamfarm", "aé" * 400 + "end", "", None, "x"])], "i int, text_norm string")
    terms = spark.createDataFrame([("er",), ("spamfarm",), ("aéaéend",), ("x",), ("farms",), ("éa" * 130,)], "term_norm string")
    few, many = (sorted(map(tuple, contained(texts, terms, 100, most).select("i", F.col("term_norm")).collect())) for most in (100, 0))
    assert few == many == [(0, "er"), (1, "spamfarm"), (2, "aéaéend"), (2, "éa" * 130), (5, "x")]


def test_sink_merges_batches(spark, tmp_path):
    import datetime

    from sparkloom.streaming import events as E

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for k, rows in enumerate([[(1, "old", day(1)), (2, "gone", day(0))], [(1, "new", day(30)), (3, "late", day(25))], [(4, "x", day(28))]]):
        spark.createDataFrame(rows, "event_id long, v string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    schema = spark.read.parquet(f"{tmp_path}/in/0.parquet").schema
    for _ in range(2):  # a second run continues and adds nothing
        E.upserting_sink(E.read_stream(spark, f"{tmp_path}/in/*.parquet", schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp", 10)
        got = {r["event_id"]: r["v"] for r in E.retained(spark, f"{tmp_path}/out", "event_id", ["event_id", "v", "ts"], 10).collect()}
        assert got == {1: "new", 3: "late", 4: "x"}


def test_types_are_retained_until_nothing_changes(spark):
    from sparkloom.operators.splits import retain_types

    labels = spark.createDataFrame([("a", "x")] * 3 + [("b", "x"), ("b", "y")] * 2 + [("c", "y")] * 2 + [("d", "z")], "comp string, kind string")
    moves = spark.createDataFrame([("a",), ("c",), ("d",)], "comp string")
    assert sorted(r["comp"] for r in retain_types(spark, moves, labels, "comp", "kind", 4).collect()) == ["a", "c"]
    assert retain_types(spark, moves, labels, "comp", "kind", 100).count() == 0


def test_spans_in_one_pass_equal_each_term_alone():
    import random
    import unicodedata

    from sparkloom.operators import automaton as A

    def alone(text, term):  # every place of one term, the first admissible one
        f = lambda s: "".join(unicodedata.normalize("NFKC", s).lower().split())
        chars = [(x, i) for i, c in enumerate(text) for x in f(c)]
        n, t = "".join(x for x, _ in chars), f(term)
        if not t or t not in f(text):
            return None
        if n != f(text):
            return (None, None)
        for at in range(len(n) - len(t) + 1):
            if n.startswith(t, at):
                a, b = chars[at][1], chars[at + len(t) - 1][1] + 1
                before = ([c for c in text[:a] if c.isspace() or c.isalnum()] or [" "])[-1]
                if len(t) > 2 or not any(c.isspace() for c in text[a:b]) or before.isspace():
                    return (a, b)
        return None

    r = random.Random(4)
    terms = ["ab", "ba", "a", "aba", "bab a", "Ab", "ｃ", "c", "é", "", " ", "ﬁ", "fi", "bc"]
    for _ in range(400):
        text = "".join(r.choice(["a", "b", " ", "c", "é", "e\u0301", "ﬁ", "ｃ", ",", "A"]) for _ in range(r.randint(0, 14)))
        got = A.spans(text, *A.spans_of(terms))
        assert got == {i: x for i, t in enumerate(terms) if (x := alone(text, t)) is not None}, text


def test_phrases_meet_only_texts_of_their_group(spark):
    import random

    from sparkloom.operators.automaton import phrases_in

    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    phrases = sorted({(g, word(r.randint(1, 5))) for g in ("x", "y", None) for _ in range(40)}, key=repr)
    texts = sorted({(g, word(r.randint(0, 12))) for g in ("x", "z", None) for _ in range(30)}, key=repr)
    p, t = spark.createDataFrame(phrases, "g string, phrase string"), spark.createDataFrame([(g, x, len(x)) for g, x in texts], "g string, text string, mark int")
    want = sorted((g, x, len(y)) for g, x in phrases for h, y in texts if g is not None and g == h and x in y)
    for many, chars in ((20_000, 10**6), (7, 50), (1, 10**6)):
        got = [tuple(x) for x in phrases_in(p.where("g IS NOT NULL"), t.where("g IS NOT NULL"), "g", many, chars).collect()]
        assert sorted(got) == want
