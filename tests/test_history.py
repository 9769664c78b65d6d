"""As-of features against a plain loop over each entity's rows, whole and cut into segments."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.operators.history import (
    History, PrefixFirst, PrefixLast, PrefixMax, PrefixSum, Rolling, SinceDays,
)

START = dt.date(2020, 1, 1)


def make_rows(seed, n=160):
    """One entity with half the rows, several rows a day, and values with long gaps."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        who = "hot" if rnd.random() < 0.5 else rnd.choice("abc")
        gap = rnd.random() < (0.9 if 40 < i < 90 else 0.2)
        rows.append((who, START + dt.timedelta(days=rnd.randrange(60)), i, rnd.randrange(2), None if gap else float(rnd.randrange(100))))
    return rows


def brute(rows):
    out = {}
    seen = {}
    for who, day, i, won, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        past = seen.setdefault(who, [])
        known = [p[4] for p in past if p[4] is not None]
        last5 = [p[3] for p in past[-5:]]
        losses = [j + 1 for j, p in enumerate(past) if p[3] == 0]
        upto = [p[4] for p in past + [(who, day, i, won, value)] if p[4] is not None]
        out[i] = (
            len(past), sum(p[3] for p in past), round(sum(last5) / len(last5), 9) if last5 else 0.5,
            round(sum(known[-20:]) / len(known[-20:]), 9) if known else -1.0, known[-1] if known else None,
            upto[-1] if upto else None, upto[0] if upto else None, losses[-1] if losses else 0,
            sum(1 for p in past if (day - p[1]).days <= 14), past[-1][1] if past else None,
        )
        past.append((who, day, i, won, value))
    return out


def computed(spark, rows, **options):
    df = spark.createDataFrame(rows, "who string, day date, i int, won int, value double")
    h = History(df, ["who"], "day", ["i"], **options).add(
        PrefixSum("n", F.lit(1)), PrefixSum("wins", F.col("won")), Rolling("form", F.col("won"), 5, 0.5),
        Rolling("mean20", F.col("value"), 20, -1.0, nullable=True), PrefixLast("last", F.col("value")),
        PrefixLast("now", F.col("value"), with_current=True), PrefixFirst("first", F.col("value")),
        SinceDays("recent", F.lit(1), 14), PrefixLast("last_day", F.col("day")))
    h.add(PrefixMax("loss_at", F.when(F.col("won") == 0, F.col("n") + 1), F.lit(0)))
    return h.segmented, {
        r["i"]: (r["n"], r["wins"], round(r["form"], 9), round(r["mean20"], 9), r["last"], r["now"], r["first"], r["loss_at"],
                 r["recent"], r["last_day"])
        for r in h.result().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_entities(spark, seed):
    rows = make_rows(seed)
    segmented, got = computed(spark, rows)
    assert not segmented and got == brute(rows)


@pytest.mark.parametrize("seed,segment_rows", [(1, 7), (2, 25)])
def test_hot_entity_is_cut_into_segments_with_equal_results(spark, seed, segment_rows):
    rows = make_rows(seed)
    segmented, got = computed(spark, rows, segment_rows=segment_rows)
    assert segmented and got == brute(rows)


def test_a_later_row_never_changes_an_earlier_feature(spark):
    rows = make_rows(5)
    day = START + dt.timedelta(days=30)
    changed = [r if r[1] <= day else (r[0], r[1], r[2], 1 - r[3], 1000.0) for r in rows]
    early = {r[2] for r in rows if r[1] <= day}
    _, a = computed(spark, rows)
    _, b = computed(spark, changed)
    assert {i: a[i] for i in early} == {i: b[i] for i in early}


def test_null_entities_are_kept(spark):
    rows = [(None, START, 1, 1, 1.0), (None, START, 2, 0, 2.0), ("a", START, 3, 1, 3.0)] * 1
    for options in ({}, {"segment_rows": 1}):
        assert len(computed(spark, rows, **options)[1]) == 3


def test_rows_of_a_task_are_bounded(spark):
    df = spark.range(6000).selectExpr("id % 500 AS p", "DATE'2000-01-01' + CAST(id % 90 AS INT) AS d", "id AS o", "id % 2 AS v")
    few = History(df, ["p"], "d", ["o"], task_rows=500).add(PrefixSum("s", F.col("v"))).result()
    assert few.groupBy(F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0] < 1500
    plain = History(df, ["p"], "d", ["o"]).add(PrefixSum("s", F.col("v"))).result()
    assert few.exceptAll(plain).count() == 0 and few.count() == 6000


def test_line_items_of_a_task_are_bounded(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    plain = views.bouts(spark, folder)
    monkeypatch.setattr(views, "LINE_ROWS", 300, raising=False)
    few = views.bouts(spark, folder)
    total = plain.count()
    assert few.groupBy(F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0] < total / 8
    assert few.exceptAll(plain).count() == 0 and few.count() == total


def test_a_history_tells_its_busiest_entity(spark):
    df = spark.createDataFrame([(1, "2000-01-01", 1), (1, "2000-01-02", 2), (2, "2000-01-01", 3)], "p int, d string, o int")
    assert History(df.withColumn("d", F.to_date("d")), ["p"], "d", ["o"]).hottest == 2
