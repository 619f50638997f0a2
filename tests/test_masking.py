"""The masking policy: order of the axes, harvested names, and what stops."""

import pytest

from sparkloom.operators import masking as K

KIND = "i int, source string, text string, anchor string"


def masked(spark, rows, policy):
    return {r.i: r for r in K.mask(spark.createDataFrame(rows, KIND), "text", "anchor", "source", policy).collect()}


def test_axes_in_their_order(spark):
    text = "Blue Rock Ltd (blue rock) at 5 Long Road. Mr. Stone of Blue Rock and Rock Face GmbH sells Shine®; Blue alone stays."
    got = masked(spark, [(1, "a", text, None), (2, "b", text, None), (3, "a", "Acme Steel Inc and Acme Steel and Acme", "Acme Steel Inc"), (4, "a", None, None), (5, None, "Ms. Hill", None)], {"a": K.AXES, "b": ("person",), None: ("person",)})
    assert got[1].masked == "[org] at [addr]. [person] of [org] and [org] sells [brand]; Blue alone stays."
    assert tuple(got[1].counts) == (3, 1, 1, 1) and sum(got[1].left) == 0
    assert got[2].masked == text.replace("Mr. Stone", "[person]") and tuple(got[2].left) == (0, 0, 0, 0)
    assert got[3].masked == "[org] and [org] and Acme"  # the longest variant first, so no part of a name is torn off
    assert got[4].masked == "" and got[5].masked == "[person]"


def test_what_is_not_declared_stops(spark):
    with pytest.raises(ValueError, match="'b' has no masking policy"):
        masked(spark, [(1, "b", "x", None)], {"a": K.AXES})
    with pytest.raises(ValueError, match="unknown axes: place"):
        masked(spark, [(1, "a", "x", None)], {"a": ("org", "place")})
