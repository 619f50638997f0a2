"""Retry rounds with carry against one conversation after the other; diverse tiers of small groups."""

import random

from sparkloom.operators.matching import retry_rounds, tier_choice


def lev(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def alike(x, y):
    n = max(len(x), len(y))
    return min(len(x), len(y)) * 5 >= n * 4 and lev(x, y) <= n // 5


def plain(rows, per_round, rounds, want):
    """rows of one group in order: (order, norm, reason)."""
    kept, judged = [], []
    for k in range(1, rounds + 1):
        for order, norm, reason in rows[(k - 1) * per_round : k * per_round]:
            if reason is None and norm is not None and any(alike(norm, x) for x in kept):
                reason = "duplicate"
            if reason is None:
                kept.append(norm)
            judged.append((order, reason, k))
        if len(kept) >= want:
            return (want, k, "ok"), judged
    return (len(kept), rounds, "search_failed"), judged


def test_rounds_equal_the_plain_loop(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(5, 11)))
    rows = [(g, o, word(), r.choice([None, None, None, "short"])) for g in range(25) for o in r.sample(range(100), r.randint(1, 14))]
    df = spark.createDataFrame(rows, "g int, o int, norm string, reason string")
    groups, judged = retry_rounds(spark, df, "g", "o", "norm", "reason", 3, 4, 3)
    got = {x.g: (x.kept, x.rounds, x.state) for x in groups.collect()}
    told = sorted((x.g, x.o, x.reason, x["round"]) for x in judged.collect() if x.reason) + sorted((x.g, x.o, None, x["round"]) for x in judged.collect() if not x.reason)
    want, each = {}, []
    for g in range(25):
        want[g], own = plain([x[1:] for x in sorted(rows) if x[0] == g], 3, 4, 3)
        each += [(g, *x) for x in own]
    assert got == want and len({x[2] for x in got.values()}) == 2
    assert told == sorted(x for x in each if x[2]) + sorted(x for x in each if not x[2])


def test_a_round_reads_only_open_groups(spark):
    rows = [(1, k, c * 20, None) for k, c in enumerate("abcdefgh")] + [(2, k, "z" * 20, None) for k in range(8)]
    df = spark.createDataFrame(rows, "g int, o int, norm string, reason string")
    groups, judged = retry_rounds(spark, df, "g", "o", "norm", "reason", 4, 5, 3)
    assert {x.g: (x.kept, x.rounds, x.state) for x in groups.collect()} == {1: (3, 1, "ok"), 2: (1, 5, "search_failed")}
    assert {x["round"] for x in judged.where("g = 1").collect()} == {1}


def test_tiers_of_small_groups(spark):
    rows = [("two", 1, 0.1, "x", ["a"]), ("two", 2, 0.2, "x", ["a"])]
    rows += [("six", 1, 0.0, "x", ["a", "b"]), ("six", 2, 0.3, "x", ["c"]), ("six", 3, 0.4, "y", ["a", "b"]), ("six", 4, 0.5, "z", []), ("six", 5, 0.8, "y", ["a", "b"]), ("six", 6, 0.9, "x", ["q"])]
    df = spark.createDataFrame(rows, "g string, k int, c double, angle string, grams array<string>")
    got = {(x.g, x.tier): x.k for x in tier_choice(df, "g", "k", "c", "angle", "grams").collect()}
    # bold: 5 has a new angle, though 6 is closer and differs more; even: 4 has an angle that neither has
    assert got == {("six", "safe"): 1, ("six", "bold"): 5, ("six", "even"): 4}
