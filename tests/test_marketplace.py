import math
import random
import statistics

from pyspark.sql import functions as F

from boutwise.functions.market import power_exponent
from boutwise.operators import marketplace

ODDS = "k string, at int, bookmaker string, lo double, hi double, tn string"


def test_consensus_is_the_plain_one_and_collects_nothing(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcdefgh"), rnd.choice([1, 2, None]), rnd.choice(["m", " m", "n", "", "flashscore_event_page", None]),
             rnd.choice([None, 0.5, 1.0, 1.5, 2.0, rnd.random() * 4]), rnd.choice([None, 1.2, 3.0, rnd.random() * 4]), rnd.choice("xyz")) for _ in range(300)]
    rows += [("solo", None, None, 1.5, 2.5, "x"), ("none", 1, "m", 0.9, 3.0, "x")]
    df = spark.createDataFrame(rows, ODDS)
    found = marketplace.market_consensus(df, ["k"], "at", "lo", "hi", True, ["tn"])
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        newest = max((x[1] for x in rows if x[0] == k and x[1] is not None), default=None)
        priced = [x for x in rows if x[0] == k and x[1] == newest and x[3] is not None and x[4] is not None and x[3] > 1 and x[4] > 1]
        makers = {x[2].strip() for x in priced if x[2] and x[2].strip() and x[2].strip() != "flashscore_event_page"}
        for name, i in (("lo", 3), ("hi", 4)):
            assert (r[name] is None) == (not priced) and (not priced or math.isclose(r[name], statistics.median(x[i] for x in priced)))
        assert r["bookmaker_count"] == (len(makers) or len(priced)) and r["tn"] == min((x[5] for x in priced), default=None)
        assert r["aggregation_method"] == ("median" if len(priced) > 1 else "single_source")
    assert {r["k"] for r in marketplace.market_consensus(df, ["k"], "at", "lo", "hi").collect()} == {k for k, r in got.items() if r["lo"] is not None}


def test_names_price_only_what_ids_leave(spark):
    pred = spark.createDataFrame([("a", 1, "1", "2", "X", "Y"), ("b", 1, "3", "4", "V", "W"), ("c", 1, None, "9", "w", "v"), ("d", 2, "1", "2", "X", "Y"), ("e", 1, "5", "6", "", "Y"), ("f", 1, "7", "8", "X", "Y")],
                                 "match_key string, match_date int, p1_id string, p2_id string, p1_name string, p2_name string")
    odds = spark.createDataFrame([(1, 1, "m", "2", "1", "Y", "X", 3.0, 1.5), (1, 1, "m", None, None, "W", "V", 4.0, 1.25), (1, 1, "m", "7", "8", "X", "Y", 0.5, 2.0)],
                                 "match_date int, captured_at int, bookmaker string, o1_id string, o2_id string, o1_name string, o2_name string, odds_p1 double, odds_p2 double")
    got = {r["match_key"]: (r["odds_p1"], r["odds_p2"]) for r in marketplace.join_predictions(pred, odds).collect()}
    # f is known by its ids, where no price holds, and so not asked for by name.
    assert got == {"a": (1.5, 3.0), "b": (1.25, 4.0), "c": (4.0, 1.25)}
    some = marketplace.join_predictions(pred.filter("match_key = 'a'"), odds)
    assert "o1_name" not in some._jdf.queryExecution().optimizedPlan().toString() and some.count() == 1


def test_exponent_is_that_of_plain_halving(spark):
    rnd = random.Random(4)
    rows = [(1 + rnd.random() * 5, 1 + rnd.random() * 5) for _ in range(200)] + [(1.0001, 1.0001), (1.01, 30.0), (2.0, 2.0), (5.0, 5.0), (1.0, 2.0)]

    def plain(a, b):
        def over(k):
            return (1 / a) ** k + (1 / b) ** k > 1
        low, high = 1.0, 2.0
        for _ in range(8):
            high = high * 2 if over(high) else high
        for _ in range(32):
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) else (low, middle)
        return high

    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", power_exponent(F.col("a"), F.col("b")).alias("k")).collect()
    assert all(math.isclose(r["k"], plain(r["a"], r["b"]), rel_tol=1e-9) for r in got)


def test_a_batch_of_many_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    from boutwise.catalog import streams
    from boutwise.streaming import odds

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    seen, merge = [], odds.movement_batch

    def spy(batch, batch_id, *args, **options):
        seen.append((batch_id, {r[0] for r in batch.select("batch").distinct().collect()}, batch.select(F.input_file_name()).distinct().count()))
        merge(batch, batch_id, *args, **options)

    monkeypatch.setattr(odds, "movement_batch", spy)
    found = streams.stream_odds_movement(spark, str(tmp_path))
    # A batch without rows is none.
    assert [values for _, values, _ in seen if values] == [{0}, {9}]  # the others have no rows there
    assert max(files for *_, files in seen) > 1
    whole = streams.stream_odds_movement(spark, "/root/testdata/sf0.001")
    assert found.exceptAll(whole).isEmpty() and found.count() == whole.count()
