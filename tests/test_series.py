import random
from decimal import Decimal
from math import ceil

import pytest
from pyspark.sql import functions as F

from chainloom.plans import audit, dist, links, series


def test_order_statistics_by_hand(spark):
    own = {"a": [1, 2, 3, 4], "b": [0] * 99 + [1], "c": [10 * k for k in range(1, 11)], "d": [1, 1, 2, 5, 10, 100], "e": list(range(1, 101)), "f": [7], "g": [0, 0], "h": [0, 5, 15, 150, 1500]}
    df = spark.createDataFrame([(k, x) for k, v in own.items() for x in v], "k string, x long")
    stats = {r.k: r for r in dist.order_stats(df, ["k"], "x").collect()}
    assert stats["a"].gini == 0.25 and stats["b"].gini == 0.99 and stats["f"].gini == 0 and stats["g"].gini == 0
    assert (stats["c"]["median"], stats["c"].p90, stats["c"].p99, stats["c"]["mean"]) == (50, 90, 100, 55)
    tail = {(r.k, r.cut): (r.tail_n, r.tail_total) for r in dist.tail_from(df, ["k"], "x", [5, 10**9]).collect()}
    assert tail["d", 5] == (3, 115) and tail["a", 10**9] == (0, 0)
    top = {(r.g, r.k): (r.n, r.top_total) for r in dist.top_n(df.withColumnRenamed("k", "g"), ["g"], "x", [2, 50]).collect()}
    assert top["d", 2] == (2, 110) and top["d", 50] == (6, 119)
    part = {(r.k, r.fraction): (r.n, r.top_total) for r in dist.top_fraction(df.withColumnRenamed("k", "g"), ["g"], "x", [0.5, 0.0001]).withColumnRenamed("g", "k").collect()}
    assert part["d", 0.5] == (3, 115) and part["d", 0.0001] == (1, 100)
    bands = [(r.n, r.band_total) for r in dist.level_histogram(df.where("k = 'h'"), ["k"], "x", [10, 100, 1000]).orderBy("band").collect()]
    assert bands == [(2, 5), (1, 15), (1, 150), (1, 1500)]
    half = dist.lorenz(df.where("k = 'e'").withColumnRenamed("k", "g"), ["g"], "x", [0.5]).first()
    assert (half.low_total, half.k) == (1275, 50)


def test_order_statistics_against_brute_force(spark):
    r = random.Random(9)
    groups = {g: [r.choice([0, 1, 5, r.randrange(10**6), r.randrange(1 << 55)]) for _ in range(r.randint(1, 400))] for g in range(5)}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [(0, None)], "g long, x long")
    for row in dist.order_stats(df, ["g"], "x").collect():
        v = sorted(groups[row.g])
        n, total = len(v), sum(v)
        num = sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(v))
        at = lambda q: v[min(max(ceil(q * n) - 1, 0), n - 1)]
        assert (row["count"], row.total, row["mean"], row["median"], row.p90, row.p99, row["max"], int(row.gini_num)) == (n, total, total // n, at(0.5), at(0.9), at(0.99), v[-1], num)
    for row in dist.lorenz(df, ["g"], "x", [0.013, 0.25, 0.5, 0.75, 1.0]).collect():
        v = sorted(groups[row.g])
        k = max(1, min(len(v), round(row.share * len(v))))
        assert (row.k, row.low_total) == (k, sum(v[:k]))


def test_deltas_and_last_lines(spark):
    curve = spark.createDataFrame([(10, 2, 1000, 0), (20, 9, 9, 1), (20, 5, 7000, 2), (30, 5, 7000, 3)], "height long, hits long, sats long, line long")
    own = series.deltas(series.last_line(curve), ["hits", "sats"])
    assert [tuple(r) for r in own.orderBy("to_height").collect()] == [(0, 10, 2, 1000), (10, 20, 3, 6000), (20, 30, 0, 0)]
    with pytest.raises(Exception, match="falls"):
        series.deltas(curve.where("line = 2 or line = 0").withColumn("hits", -F.col("hits")), ["hits"]).collect()


def test_asof(spark):
    t0 = 1_700_000_000
    prices = spark.createDataFrame([(t0 - 100, Decimal("100.50")), (t0 + 3, Decimal("200"))], "ts long, p decimal(20,6)")
    times = [t0 - 101, t0 - 100, t0 + 2, t0 + 3, t0 + 3 + 10_800, t0 + 4 + 10_800, None]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "height int, time long")
    for bucket in (1, 60, 86_400, 1 << 40):
        got = {r.height: r.price for r in series.asof(asked, prices, "time", "ts", "p", 3 * 3600, bucket=bucket).collect()}
        assert [got[i] and float(got[i]) for i in range(7)] == [None, 100.5, 100.5, 200, 200, None, None]
    other = spark.createDataFrame([(t0 - 500, Decimal("1"))], "ts long, p decimal(20,6)")
    both = series.asof_first(asked, [(prices, 10_800), (other, 400)], "time", "ts", "p").collect()
    assert {r.height: r.series for r in both} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_asof_against_brute_force(spark):
    r = random.Random(8)
    right = [(r.randrange(2000), r.randrange(50)) for _ in range(300)]
    left = [(i, r.randrange(2200)) for i in range(500)]
    a, b = spark.createDataFrame(left, "i int, t long"), spark.createDataFrame(right, "ts long, v long")
    for stale in (3, 40, 10_000):
        for x in series.asof(a, b, "t", "ts", "v", stale, bucket=37).collect():
            past = [p for p in right if p[0] <= x.t]
            last = max((p[0] for p in past), default=None)
            assert x.price == (min(v for t, v in past if t == last) if past and x.t - last <= stale else None)


def test_daily_and_medians(spark):
    day = 86_400
    rows = [(0, None, None), (day, "1", "b"), (day + 5, "2", "a"), (4 * day, None, None), (5 * day, "3", "a")]
    df = spark.createDataFrame(rows, "time long, price string, series string").withColumn("price", F.col("price").cast("decimal(20,6)"))
    got = [(r.date[-2:], r.blocks, r.price and float(r.price), r.kind, r.gap_days, r.series) for r in series.daily(df).orderBy("date").collect()]
    assert got == [("01", 1, None, "none", None, ""), ("02", 2, 1.5, "measured", 0, "a+b"), ("03", 0, 1.5, "carried", 1, ""), ("04", 0, 1.5, "carried", 2, ""), ("05", 1, 1.5, "carried", 3, ""), ("06", 1, 3.0, "measured", 0, "a")]
    assert series.daily(df.limit(0)).collect() == []
    times = [5, 3, 9, 1, 7, 2, 8, 4, 6, 0, 11, 10, 12]
    own = series.median_time_past(spark.createDataFrame(list(enumerate(times)), "height int, time long"))
    for x in own.collect():
        span = sorted(times[max(0, x.height - 10) : x.height + 1])
        assert x.median_time == span[len(span) // 2]


def test_windows_counts_and_gaps(spark):
    events = spark.createDataFrame([(1, "a"), (10, "a"), (11, "b"), (35, "b")], "height long, kind string")
    got = [tuple(r) for r in series.window_counts(events, ["a", "b"], 10, 36).orderBy("height").collect()]
    assert got == [(10, 2, 0, 2), (20, 0, 1, 1), (30, 0, 0, 0), (36, 0, 1, 1)]
    runs = spark.createDataFrame([(1, 10), (11, 20), (25, 30), (28, 40)], "from_height long, to_height long")
    assert [tuple(r) for r in audit.gaps(runs).collect()] == [(25, 30, "gap"), (28, 40, "overlap")]
    lines = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 2)], "line long, v long")
    assert series.in_order(lines, ["v"], True).first()[0] == 2 and series.in_order(lines, ["v"], False).first()[0] == 1
    digests = [audit.interval_digests(events.where(c), ["kind"], "height", ["kind"], 10) for c in ("height > 0", "height > 0 and height <> 11")]
    assert {(r.from_height, r.verdict) for r in audit.compared_digests(*digests).collect()} == {(1, "OK"), (11, "SKIPPED"), (31, "OK")}


def test_caps_and_separations(spark):
    rows = [("x", o, s) for o, s in enumerate([1, 1, 2, 3, 3])] + [("y", 9, 1), ("y", 10, 7), ("z", 11, 2)]
    own = spark.createDataFrame(rows, "lock string, out_ord long, spender_tx long")
    asked = spark.createDataFrame([("x",), ("q",)], "lock string")
    got = {(cap, r.lock): tuple(r)[1:] for cap in (1, 2, 3, 4) for r in links.co_inputs(own, asked, cap).collect()}
    assert got[4, "x"] == (3, 2, 2, False) and got[3, "x"] == (3, 2, 2, True) and got[2, "x"] == (2, 2, 2, True) and got[1, "x"] == (1, 1, 1, True) and got[4, "q"] == (0, 0, 0, False)
    assert [r.truncated for r in links.capped_spenders(own.where("lock = 'x'"), 3).collect()] == [False] * 3
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    breaks = spark.createDataFrame([("b", "a", "common_input", 3), ("a", "b", "same_key", 9), ("a", "a", "same_key", 1)], "group_a string, group_b string, broken_by string, at_height long")
    assert sorted(tuple(r) for r in links.separations(groups, breaks).collect()) == [("a", "b", False, "same_key", 9), ("a", "c", True, None, None), ("b", "c", True, None, None)]
