"""Loss causes, globs and two-sided deltas on small tables."""

import re

from sparkloom.operators import governance as G


def test_causes_in_their_order(spark):
    kind = "path string, sha string, size long"
    ledger = spark.createDataFrame([("a/1", "h1", 1), ("a/2", "h2", 2), ("a/3.part", "h3", 3), ("a/4", "h4", 4), ("b/5", "h5", 5), ("a/6", "h6", 6), ("a/7", "h7", 7), ("b/8.part", "h1", 8), ("a/9", None, 9)], kind)
    disk = spark.createDataFrame([("a/1", "h1", 1), ("c/2", "h2", 2), ("a/new", "x", 4), ("a/7b", "y", 70), ("c/6", "z", 6), ("c/null", None, 0)], kind)
    got = {r.path: r.cause for r in G.missing_causes(ledger, disk, ["**.part"]).collect()}
    assert got == {"a/2": "moved", "a/3.part": "excluded", "a/4": "replaced", "b/5": "cleared", "a/6": "lost", "a/7": "lost", "b/8.part": "moved", "a/9": "lost"}


def test_globs():
    fits = lambda g, p: re.search(G.glob_pattern(g), p) is not None
    assert fits("a/*.txt", "a/b.txt") and not fits("a/*.txt", "a/b/c.txt") and fits("a/**.txt", "a/b/c.txt")
    assert fits("a?c", "abc") and not fits("a?c", "a/c") and not fits("a.c", "abc") and fits("a+(1)", "a+(1)")


def test_delta_of_source_and_rule(spark):
    old = spark.createDataFrame([(1, 5), (2, 3), (3, None)], "k int, n int")
    new = spark.createDataFrame([(2, 4), (3, 2), (4, 10)], "k int, n int")
    assert tuple(G.run_delta(old, new, "k", "n").first()) == (1, 1, 2, 8, 16, 10 - 5, 4 + 2 - 3)
    assert tuple(G.run_delta(old.limit(0), new.limit(0), "k", "n").first()) == (0, 0, 0, 0, 0, 0, 0)
