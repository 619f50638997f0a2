"""The label round against one row after the other, and spellings within one edit against all pairs."""

import hashlib

import pytest

from sparkloom.operators.matching import one_edit
from sparkloom.operators.splits import label_round, water_fill

PEOPLE = ["ana", "ben", "cem", "dia"]


def plain(rows, overlap):
    """rows: (id, gold, seen). The least loaded person, row by row."""
    seeded = lambda xs: sorted(xs, key=lambda r: (hashlib.sha256(f"s|{r[0]}".encode()).hexdigest(), r[0]))
    again = [r for r in rows if set(r[2] or []) & set(PEOPLE)]
    rest = [r for r in rows if r not in again]
    out = [(r[0], p, "gold") for r in rest if r[1] for p in PEOPLE]
    fresh = seeded([r for r in rest if not r[1]])
    n = int(len(fresh) * overlap + 0.5)
    out += [(r[0], p, "shared") for r in fresh[:n] for p in PEOPLE]
    load = dict.fromkeys(PEOPLE, 0)

    def give(r, free, part):
        who = min(free, key=lambda p: load[p])
        load[who] += 1
        out.append((r[0], who, part))

    for r in fresh[n:]:
        give(r, PEOPLE, "own")
    free = lambda r: [p for p in PEOPLE if p not in r[2]]
    for r in sorted(seeded(again), key=lambda r: (len(free(r)), ",".join(sorted(set(r[2]) & set(PEOPLE))))):
        give(r, free(r), "again")
    return out, load


def test_round_equals_the_plain_one_in_loads(spark):
    rows = [(i, i % 11 == 0, [p for k, p in enumerate(PEOPLE) if i % 5 == 2 and (i >> k) & 1 and not (i % 20 == 17 and k == 3)][:3] + (["else"] if i % 7 == 0 else [])) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, gold boolean, seen array<string>")
    got = [tuple(r) for r in label_round(df, "id", PEOPLE, 0.2, "s", "gold", "seen").collect()]
    want, load = plain(rows, 0.2)
    assert sorted(x for x in got if x[2] != "again") == sorted(x for x in want if x[2] != "again")
    own = dict.fromkeys(PEOPLE, 0)
    for _, p, part in got:
        own[p] += part in ("own", "again")
    assert own == load
    seen = {r[0]: r[2] for r in rows}
    assert all(p not in seen[i] for i, p, part in got if part == "again")
    assert sorted(i for i, _, part in got if part == "again") == sorted(i for i, _, part in want if part == "again")


def test_stops_when_nobody_is_left(spark):
    df = spark.createDataFrame([(1, False, PEOPLE), (2, False, None)], "id long, gold boolean, seen array<string>")
    with pytest.raises(ValueError, match="nobody is left for 1"):
        label_round(df, "id", PEOPLE, 0.2, "s", "gold", "seen")


def test_water_fill_is_the_least_loaded_choice():
    for load in ({"a": 3, "b": 0, "c": 7}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 9, "c": 9}):
        for n in range(40):
            one = dict(load)
            for _ in range(n):
                one[min(one, key=lambda p: one[p])] += 1
            got = water_fill(load, list(load), n)
            assert {p: load[p] + got[p] for p in load} == one


def test_one_edit_equals_all_pairs(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("aab") for _ in range(r.randint(0, 6)))
    a, b = sorted({word() for _ in range(80)}), sorted({word() for _ in range(80)})

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    got = {tuple(x) for x in one_edit(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(x,) for x in b], "y string"), "x", "y").collect()}
    assert got == {(x, y) for x in a for y in b if lev(x, y) == 1}
