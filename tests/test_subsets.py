"""Spaced subsets: hand-worked tables and the properties that define them."""

import datetime as dt
import random

import pytest

from chatlake.operators import subsets as sub

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "owner_id string, k long, ts timestamp"


def _picked(spark, hours, specs):
    df = spark.createDataFrame([("o", k, BASE + dt.timedelta(hours=h)) for k, h in enumerate(hours)], SCHEMA)
    out = {}
    for r in sub.spaced_subsets(df, ["owner_id"], ["k"], specs).collect():
        out.setdefault(r.subset_name, set()).add(r.k)
    return out


@pytest.mark.parametrize("span", [1 << 20, 1, 3])
def test_hand_worked(spark, monkeypatch, span):
    monkeypatch.setattr(sub, "SPAN_NODES", span)   # 1: every bucket is a span of its own
    specs = [sub.SubsetSpec("three", 3, 4), sub.SubsetSpec("four", 4, 4), sub.SubsetSpec("most", 6, 4), sub.SubsetSpec("all", 9, 4), sub.SubsetSpec("tail", 2, None)]
    # newest first: 20 (k 6), 17, 16 (k 4), 15, 12 (k 2), 3, 0 (k 0)
    got = _picked(spark, [0, 3, 12, 15, 16, 17, 20], specs)
    assert got["three"] == {6, 4, 2} and got["four"] == {6, 4, 2, 1}
    assert got["most"] == {6, 4, 2, 1, 5, 3}               # spaced rows 20, 16, 12, 3; then the newest left over
    assert "all" not in got and got["tail"] == {5, 6}      # more asked for than there is: no such subset


@pytest.mark.parametrize("span", [1 << 20, 1, 3])
def test_properties(spark, monkeypatch, span):
    monkeypatch.setattr(sub, "SPAN_NODES", span)
    rnd = random.Random(21)
    hours = [rnd.choice([0, 1, 2, 3, 5, 8]) * rnd.randint(0, 30) for _ in range(100)]
    got = _picked(spark, hours, [sub.SubsetSpec("few", 5, 4), sub.SubsetSpec("many", 60, 4)])
    few = sorted((hours[k] for k in got["few"]), reverse=True)
    assert len(few) == 5 and few[0] == max(hours)
    for newer, older in zip(few, few[1:]):                 # spaced, and no row between is spaced as well
        assert newer - older >= 4 and not [h for h in hours if older < h <= newer - 4]
    assert len(got["many"]) == 60 and got["few"] <= got["many"]


@pytest.mark.parametrize("span", [1, 4, 1 << 20])
def test_walks_over_spans_equal_the_plain_walk(spark, span):
    rnd = random.Random(span)
    nodes, want = [], set()
    for key in range(60):
        gap, size = rnd.choice([1, 3, 10, 50]), rnd.choice([1, 2, 5, 30, 400])
        ts = sorted({rnd.randint(1, rnd.choice([20, 300, 3000])) for _ in range(rnd.randint(1, 200))})
        nodes += [(key, gap, size, t) for t in ts]
        at, pos = ts[-1], 0
        while at is not None and pos < size:
            want.add((key, at, pos))
            at, pos = max((t for t in ts if t <= at - gap), default=None), pos + 1
    df = spark.createDataFrame(nodes, "k long, gap_us long, size int, t long")
    assert {(r.k, r.t, r.pos) for r in sub.greedy_picks(df, ["k"], span).collect()} == want


def test_rows_before_the_epoch_and_without_time(spark):
    old = [("a", 0, dt.datetime(1960, 1, 1)), ("a", 1, dt.datetime(1959, 1, 1)), ("a", 2, None), ("b", 3, BASE), ("b", 4, dt.datetime(1960, 1, 1)), ("b", 5, dt.datetime(1970, 1, 2))]
    df = spark.createDataFrame(old, SCHEMA)
    got = {(r.owner_id, r.k, r.picked) for r in sub.spaced_subsets(df, ["owner_id"], ["k"], [sub.SubsetSpec("two", 2, 4)]).collect()}
    assert got == {("a", 0, True), ("a", 1, False), ("b", 3, True), ("b", 5, True)}
    rest = sub.validation_split(df, spark.createDataFrame([("b", BASE)], "owner_id string, ts timestamp"), ["owner_id"], ["k"], sub.SubsetSpec("v", 3, 4))
    assert {(r.owner_id, r.k) for r in rest.collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 4), ("b", 5)}
