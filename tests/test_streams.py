"""Streams with keyed state: restarts, late rows, rows in any order; against plain Python."""

import datetime as dt

import numpy as np
import pytest

from barloom.streaming import stateful


def day(n):
    return dt.date(2011, 5, 17) + dt.timedelta(days=n)


BARS, ASKED = "symbol string, bar_date date, close double", "symbol string, as_of date"
WRITES = "key long, as_of date, value double, created_at timestamp"


@pytest.fixture
def settle(spark, tmp_path):
    """A run of the settlement stream over what arrives: each is a restart."""
    folder = f"file://{tmp_path}"

    def run(bars, asked):
        for name, rows, schema in (("bars", bars, BARS), ("asked", asked, ASKED)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = (spark.readStream.schema(x).parquet(f"{folder}/{n}") for n, x in (("bars", BARS), ("asked", ASKED)))
        out = stateful.stream_settle(*streams, f"{folder}/settled", f"{folder}/checkpoint", h=2, delay="3 days")
        return sorted((r.symbol, r.as_of, round(r.realized, 9), r.settled_at) for r in out.collect())

    return run


def log(a, b):
    return round(float(np.log(b / a)), 9)


def test_settlement_waits_for_the_watermark_and_goes_on_after_restarts(settle):
    a = [("A", day(i), 100.0 + i) for i in range(5)]
    assert settle(a, [("A", day(0)), ("A", day(1)), ("A", day(4))]) == []  # the watermark is day 1: nothing is final yet
    got = settle([("A", day(i), 100.0 + i) for i in range(5, 10)], [("A", day(9)), ("A", day(8))])
    want = [("A", day(i), log(100 + i, 102 + i), day(i + 2)) for i in (0, 1, 4)]
    assert got == want  # final up to day 6; repeated runs add nothing
    assert settle([], []) == want
    got = settle([("B", day(30), 1.0)], [("B", day(30))])  # another symbol moves the watermark: day 8 and 9 lack a second bar
    assert got == want
    got = settle([("A", day(31), 131.0), ("A", day(32), 132.0), ("B", day(60), 2.0)], [("B", day(60))])
    assert got == sorted([*want, ("A", day(8), log(108, 131), day(31)), ("A", day(9), log(109, 132), day(32))])


def test_late_bars_within_the_delay_count_and_later_ones_do_not(settle):
    settle([("A", day(0), 100.0), ("A", day(2), 102.0), ("A", day(3), 103.0)], [("A", day(0)), ("A", day(3))])
    settle([("A", day(1), 101.0), ("A", day(3), 113.0)], [])  # out of order, and a correction
    got = settle([("A", day(10), 110.0)], [("A", day(10))])
    assert got == [("A", day(0), log(100, 102), day(2))]  # the late bar of day 1 is the first after day 0
    got = settle([("A", day(4), 104.0), ("A", day(11), 111.0), ("A", day(20), 120.0)], [("A", day(20))])
    assert got == [("A", day(0), log(100, 102), day(2)), ("A", day(3), log(113, 111), day(11))]  # day 4 came after the watermark


def test_a_prediction_without_a_bar_or_with_bad_closes(settle):
    bars = [("A", day(0), 0.0), ("A", day(1), 101.0), ("A", day(2), -1.0), ("A", day(3), 103.0), ("A", day(4), 104.0), (None, day(1), 5.0), ("A", None, 5.0)]
    settle(bars, [("A", day(0)), ("A", day(1)), ("A", day(1)), ("N", day(2)), (None, day(1)), ("A", None)])
    assert settle([("A", day(20), 1.0)], [("Z", day(20))]) == [("A", day(1), log(101, 104), day(4))]  # bars without a positive close do not count


def test_settlement_in_random_order_is_that_of_the_whole_table(settle):
    rng = np.random.default_rng(4)
    bars = [(f"S{s}", day(int(d)), float(rng.uniform(50, 150))) for s in range(4) for d in sorted(rng.choice(60, 40, replace=False))]
    asked = [(s, d) for s, d, _ in bars if rng.random() < 0.5]
    for lo, hi in ((0, 15), (15, 30), (30, 45), (45, 99)):
        near = lambda d, lo=lo, hi=hi: lo <= (d - day(0)).days < hi
        got = settle([b for b in rng.permutation(np.array(bars, object)).tolist() if near(b[1])], [a for a in asked if near(a[1])])
    final = min(max(b[1] for b in bars), max(a[1] for a in asked)) - dt.timedelta(days=3)
    want = []
    for s, d in asked:
        own = sorted((x, c) for n, x, c in bars if n == s)
        i = [x for x, _ in own].index(d)
        if i + 2 < len(own) and own[i + 2][0] <= final:
            want.append((s, d, log(own[i][1], own[i + 2][1]), own[i + 2][0]))
    assert got == sorted(want) and len(want) > 30


def test_snapshots_are_hidden_until_their_session_ends(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def at(d, h, m=0):
        return dt.datetime.combine(day(d), dt.time(h, m), dt.timezone.utc)

    def run(rows):
        spark.createDataFrame(rows, WRITES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = stateful.stream_snapshots(spark.readStream.schema(WRITES).parquet(f"{folder}/in"), f"{folder}/shown", f"{folder}/checkpoint")
        newest = {(r.key, r.as_of): (r.value, r.is_final) for r in stateful.newest_shown(out).collect()}
        return newest, out.count()

    assert run([(1, day(0), 1.0, at(0, 9)), (1, day(0), 2.0, at(0, 15)), (1, day(0), None, at(0, 10)), (2, day(0), 5.0, at(0, 16))]) == ({}, 0)  # the session is on
    shown = {(1, day(0)): (2.0, False), (2, day(0)): (5.0, False)}
    assert run([(3, day(0), 9.0, at(0, 21, 30))]) == (shown | {(3, day(0)): (9.0, True)}, 3)
    newest, n = run([(1, day(0), 3.0, at(0, 21, 40)), (2, day(0), 4.0, at(0, 14))])  # a final write, and one that is late
    assert newest == {(1, day(0)): (3.0, True), (2, day(0)): (5.0, False), (3, day(0)): (9.0, True)}
    newest, n = run([(1, day(1), 7.0, at(1, 9)), (None, day(1), 1.0, at(1, 9)), (1, None, 1.0, at(1, 9))])
    assert newest[1, day(0)] == (3.0, True) and (1, day(1)) not in newest
    assert run([(9, day(3), 1.0, at(3, 1))])[0][1, day(1)] == (7.0, False)
