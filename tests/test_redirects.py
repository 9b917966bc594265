"""Redirect chains against a walk along them, entry by entry."""

import pytest

from folioscope.operators import redirects


def walk(edges):
    to = {(a, s): d for a, s, d in edges}
    ends = {}
    for a, s in to:
        at, hops = s, 0
        while (a, at) in to and hops < redirects.MOST_ENTRIES:
            at, hops = to[a, at], hops + 1
        ends[a, s] = (at, hops) if at is not None and hops < redirects.MOST_ENTRIES else (None, None)
    return ends


CASES = {
    "none": [],
    "one hop": [("a", 1, 0), ("a", 2, 0), ("b", 1, 7)],
    "circles": [("a", 1, 2), ("a", 2, 1), ("a", 3, 3), ("a", 4, 1), ("b", 1, 2)],
    "dangling": [("a", 1, 99), ("a", 2, 1)],
    "longest": [("a", i + 1, i) for i in range(60)] + [("b", i + 1, i) for i in range(3)],
}


@pytest.mark.parametrize("name", CASES)
def test_closure(spark, name):
    edges = spark.createDataFrame(CASES[name], "archive string, src long, dst long")
    got = {(r["archive"], r["src"]): (r["terminal"], r["hops"]) for r in redirects.closure(edges).collect()}
    assert got == walk(CASES[name])


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most", [1, 3, 50])
def test_reached(spark, name, most):
    to = {(a, s): d for a, s, d in CASES[name]}
    far = {}
    for a, s in to:
        at, hops = s, 0
        while (a, at) in to and hops < most:
            at, hops = to[a, at], hops + 1
        far[a, s] = (at, hops)
    edges = spark.createDataFrame(CASES[name], "archive string, src long, dst long")
    assert {(r["archive"], r["src"]): (r["terminal"], r["hops"]) for r in redirects.reached(edges, most).collect()} == far


def test_null_target(spark):
    edges = spark.createDataFrame([("a", 1, None), ("a", 2, 1)], "archive string, src long, dst long")
    got = {r["src"]: r["terminal"] for r in redirects.closure(edges).collect()}
    assert got == {1: None, 2: None}


def test_plan_has_no_round(spark):
    edges = spark.createDataFrame(CASES["longest"], "archive string, src long, dst long")
    plan = redirects.closure(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
