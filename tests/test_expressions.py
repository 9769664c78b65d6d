"""Golden values of the scalar expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from boutwise.functions import contest, market, scores, text


def one(spark, columns, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


@pytest.mark.parametrize("score,expected", [
    ("6-3 6-4", (2, 0, 19, False)), ("7-6(5) 3-6 6-4", (2, 1, 32, False)), ("6-3 RET", (1, 0, 9, True)),
    ("W/O", (None, None, None, True)), ("", (None, None, None, False)), (None, (None, None, None, False)),
    ("1-6 5-7", (0, 2, 19, False)), ("6-4 x-3 2-1-1", (1, 0, 10, False))])
def test_parse_score(spark, score, expected):
    got = one(spark, scores.parse_score(F.col("s")), s=("string", score))
    assert tuple(got.values()) == expected


@pytest.mark.parametrize("raw,expected", [("206173.0", "206173"), (" nan ", None), ("", None), ("AB12", "AB12"), (None, None), (" 7 ", "7")])
def test_canonical_id(spark, raw, expected):
    assert one(spark, {"v": text.canonical_id(F.col("s"))}, s=("string", raw))["v"] == expected


def test_normalize_name(spark):
    got = one(spark, {"a": text.normalize_name(F.col("s")), "b": text.normalize_name(F.col("s"), text.WIDE_PUNCTUATION)}, s=("string", " J.-W. O'Tsonga_x "))
    assert got == {"a": "j w o'tsonga_x", "b": "j w o tsonga x"}


@pytest.mark.parametrize("raw,draw,expected", [
    ("2R", 32, "R16"), ("2R", 96, "R64"), ("Final", 128, "F"), ("1st round", 28, "R32"), (None, 64, "R32"), ("junk", 64, "R32"), ("4R", 128, "R16")])
def test_normalize_round(spark, raw, draw, expected):
    assert one(spark, {"v": scores.normalize_round(F.col("s"), F.col("d"))}, s=("string", raw), d=("int", draw))["v"] == expected


def test_power_method(spark):
    got = one(spark, market.remove_overround(F.col("a"), F.col("b")), a=("double", 10.5), b=("double", 1.045))
    assert got["exponent"] == pytest.approx(1.246232, abs=1e-6) and got["fair_p1"] + got["fair_p2"] == pytest.approx(1.0)
    low, high, q1, q2 = 1.0, 2.0, 1 / 10.5, 1 / 1.045
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if q1**mid + q2**mid > 1 else (low, mid)
    assert got["exponent"] == pytest.approx(high, abs=1e-8)
    flat = one(spark, market.remove_overround(F.col("a"), F.col("b")), a=("double", 2.1), b=("double", 2.1))
    assert (flat["fair_p1"], flat["fair_p2"]) == (0.5, 0.5)


def test_tier_and_agreement(spark):
    got = one(spark, market.blend({"a": F.col("a"), "b": F.col("b")}, {"a": 0.6, "b": 0.4}), a=("double", 0.0754), b=("double", 0.0659))
    assert got["confidence_tier"] == "HIGH" and got["model_agreement"] == pytest.approx(0.9905)
    alone = one(spark, market.blend({"a": F.col("a"), "b": F.col("b")}, {"a": 0.6, "b": 0.4}), a=("double", 0.2), b=("double", None))
    assert alone["ensemble_prob"] == pytest.approx(0.2)


def test_order_pair_ignores_the_result(spark):
    c = contest.order_pair(F.col("a"), F.col("an"), F.col("b"), F.col("bn"))

    def first(a, an, b, bn):
        return one(spark, {"v": c}, a=("string", a), an=("string", an), b=("string", b), bn=("string", bn))["v"]

    assert first("9", "Z", "10", "A") and not first("10", "A", "9", "Z")
    assert first("10", "Z", "X1", "A") and first("X2", "Abe", "X1", "Zoe") and not first("X1", "Zoe", "X2", "Abe")


def test_serve_ratios_guard_denominators(spark):
    zero = [F.lit(0)] * 10
    assert all(v is None for v in one(spark, contest.serve_ratios(*zero), s=("int", 1)).values())


def test_header_and_event(spark):
    got = one(spark, text.parse_header(F.col("s")), s=("string", "Indian Wells (USA), hard\nATP - SINGLES: \n1"))
    assert got == {"tour": "atp", "tournament": "Indian Wells (USA), hard", "surface": "Hard", "level": "A"}
    assert one(spark, text.parse_header(F.col("s")), s=("string", "Wimbledon, grass|WTA - Singles"))["level"] == "G"
    assert one(spark, text.parse_header(F.col("s")), s=("string", "only one part"))["tour"] is None
    when = one(spark, text.event_time(F.col("s"), F.lit(2023)), s=("string", "5.3. 14:30"))
    assert when == {"match_date": dt.date(2023, 3, 5), "match_time": "14:30"}


def test_staleness(spark):
    day = dt.date(2024, 1, 20)
    for behind, status in ((0, "fresh"), (4, "warning"), (10, "stale"), (30, "critical")):
        got = one(spark, contest.staleness(F.col("d"), F.lit("2024-01-20").cast("date")), d=("date", day - dt.timedelta(days=behind)))
        assert (got["days_behind"], got["status"]) == (behind, status)
    assert one(spark, contest.staleness(F.col("d"), F.lit("2024-01-20").cast("date")), d=("date", None))["status"] == "unknown"


def test_figures_of_a_score_are_read_once(spark):
    df = spark.createDataFrame([("6-4 3-6 7-6(5)",), ("W/O",), (None,)], "s string")
    plan = df.select(scores.set_figures(F.col("s")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    held = df.withColumn("f", scores.set_figures(F.col("s"))).select(*[c.alias(n) for n, c in scores.parse_score(F.col("s"), F.col("f")).items()])
    plain = df.select(*[c.alias(n) for n, c in scores.parse_score(F.col("s")).items()])
    assert [tuple(r) for r in held.collect()] == [tuple(r) for r in plain.collect()] == [(2, 1, 32, False), (None, None, None, True), (None, None, None, False)]
