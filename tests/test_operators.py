"""Operators against plain Python on small inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.operators import asof, equity, keyed, learning, marketplace, quantiles, ratings, resolve, splits
from boutwise.sources import merge


def test_exact_median_and_order_statistic(spark):
    rnd = random.Random(1)
    data = [(g, rnd.choice([1.0, 2.0, rnd.random() * 100])) for g in "ab" for _ in range(201 if g == "a" else 100)] + [("c", None), ("c", 5.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["v"] for r in quantiles.median(df, ["g"], "v").collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.median([v for k, v in data if k == g and v is not None]))
    third = {r["g"]: r["v"] for r in quantiles.higher_quantile(df, ["g"], "v", F.least(F.lit(3), F.col("n"))).collect()}
    assert third["a"] == sorted(v for k, v in data if k == "a")[2]


def test_positions_and_folds(spark):
    rnd = random.Random(2)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(20)), rnd.randrange(9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "d date, t long, n int")
    ordered = sorted(rows)
    assert splits.position_keys(df, ["d", "t", "n"], [0, 7, 200, 399]) == {p: ordered[p] for p in (0, 7, 200, 399)}
    parts = splits.split_temporal(df, ["d", "t", "n"], "2030-01-01", months=0)
    assert {tuple(r)[:3] for r in parts.filter("split = 'train'").collect()} == set(ordered[:320])
    folds = splits.temporal_folds(df, ["d", "t", "n"], 3, 200, 50).collect()
    for fold, a, b, c in splits.fold_spans(400, 3, 200, 50):
        assert {tuple(r)[:3] for r in folds if r["fold"] == fold and r["role"] == "train"} == set(ordered[a:b])
        assert {tuple(r)[:3] for r in folds if r["fold"] == fold and r["role"] == "test"} == set(ordered[b:c])


def test_split_modes(spark):
    days = [(dt.date(2020, m, 1), 1, m) for m in range(1, 13)]
    df = spark.createDataFrame(days, "d date, t long, n int")
    mode = lambda cutoff: splits.split_temporal(df, ["d", "t", "n"], cutoff).first()["split_mode"]
    assert mode("2020-06-01") == "strict_cutoff" and mode("2030-01-01") == "fallback_latest_3m"
    assert splits.split_temporal(df.filter("n = 1").union(df.filter("n = 1")), ["d", "t", "n"], "2030-01-01").first()["split_mode"] == "fallback_80_20_temporal"


def test_clamped_ledger(spark):
    rnd = random.Random(3)
    rows = [("x" if i % 3 else "y", dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), i, float(rnd.randrange(-60, 50))) for i in range(120)]
    df = spark.createDataFrame(rows, "acct string, d date, i int, pnl double")
    want, capital = {}, {"x": 40.0, "y": 40.0}
    for a, _, i, p in rows:
        before = capital[a]
        capital[a] = max(0.0, before + p)
        want[i] = (before, capital[a])
    for options in ({}, {"segment_rows": 9}):
        got = {r["i"]: (r["capital_before"], r["capital_after"]) for r in equity.bankroll_ledger(df, ["acct"], "d", ["i"], "pnl", 40.0, **options).collect()}
        assert got == want


def test_asof_previous_is_strict(spark):
    cur = spark.createDataFrame([("k", 5, 1), ("k", 9, 2), ("z", 1, 3)], "k string, t int, id int")
    past = spark.createDataFrame([("k", 5, 50.0), ("k", 3, 30.0), ("k", 8, 80.0), ("k", 99, 99.0)], "k string, t int, v double")
    day = F.lit("2020-01-01").cast("date")
    got = {r["id"]: (r["prev_t"], r["prev_v"]) for r in marketplace.asof_previous(cur, past, ["k"], "t", ["v"], day=day).collect()}
    assert got == {1: (3, 30.0), 2: (8, 80.0), 3: (None, None)}


def test_join_predictions_by_id_then_name(spark):
    d = dt.date(2024, 1, 1)
    pred = spark.createDataFrame([("a", d, 1, 2, "x", "y"), ("b", d, 3, None, "p", "q"), ("c", d, 8, 9, "m", "n"), ("e", d, 5, 6, "u", "v")],
                                 "match_key string, match_date date, p1_id long, p2_id long, p1_name string, p2_name string")
    odds = spark.createDataFrame([
        (d, "t1", "mk", 2, 1, "y", "x", 9.0, 9.0), (d, "t2", "m1", 2, 1, "y", "x", 3.0, 1.4), (d, "t2", "m2", 1, 2, "x", "y", 1.6, 2.6),
        (d, "t1", " ", 3, 4, "q", "p", 5.0, 1.1), (d, "t1", "m1", 5, 6, "u", "v", 0.9, 4.0), (d, "t0", "m1", 5, 6, "u", "v", 2.0, 2.0)],
        "match_date date, captured_at string, bookmaker string, o1_id long, o2_id long, o1_name string, o2_name string, odds_p1 double, odds_p2 double")
    got = {r["match_key"]: (r["odds_p1"], r["odds_p2"], r["bookmaker_count"], r["aggregation_method"])
           for r in marketplace.join_predictions(pred, odds).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == (pytest.approx(1.5), pytest.approx(2.8), 2, "median") and got["b"] == (1.1, 5.0, 1, "single_source")


def test_daily_allocation_keeps_to_the_cap(spark):
    rows = [("d", f"k{i}", 0.9, 3.0 + i / 10, 0.3) for i in range(5)]
    df = spark.createDataFrame(rows, "d string, match_key string, selected_prob double, selected_odds double, selected_edge double")
    got = marketplace.allocate_daily(df, ["d"], ["match_key"], 100.0).collect()
    assert len(got) == 3 and sum(r["share"] for r in got) == pytest.approx(0.5) and sum(r["stake"] for r in got) <= 50.01
    assert all(r["stake"] == 0 for r in marketplace.allocate_daily(df, ["d"], ["match_key"], 0.0).collect())


def elo_loop(matches):
    overall, surface, out = {}, {}, {}
    for key, _, w, l, s, k in matches:
        wo, lo = overall.get(w, 1500.0), overall.get(l, 1500.0)
        ws, ls = surface.get((w, s), wo), surface.get((l, s), lo)
        change = k * (1 - 1 / (1 + 10 ** (((0.7 * lo + 0.3 * ls) - (0.7 * wo + 0.3 * ws)) / 400)))
        out[(key, w)], out[(key, l)] = (wo, ws, change), (lo, ls, -change)
        overall[w], overall[l], surface[(w, s)], surface[(l, s)] = wo + change, lo - change, ws + change, ls - change
    return out


def rating_rows(spark, matches, tour="atp"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame(
        [(tour, key, p, w, l, s, k, day + dt.timedelta(days=i // 5), 1, i) for i, (key, p, w, l, s, k) in enumerate(matches)],
        "tour string, match_key string, period int, winner_id string, loser_id string, surface string, k double, day date, a int, b int")


def by_event(events):
    return {(r["match_key"], r["player_id"]): (r["elo_pre"], r["surface_elo_pre"], r["change"]) for r in events.collect()}


def test_sequential_ratings_equal_the_loop(spark):
    rnd = random.Random(4)
    matches = [(f"m{i}", i // 20, *rnd.sample("abcde", 2), rnd.choice(["Hard", "Clay"]), rnd.choice([32.0, 28.8])) for i in range(40)]
    want = elo_loop(matches)
    for segment_rows in (10**6, 6):
        events, state = ratings.sequential_ratings(rating_rows(spark, matches), tolerance=1e-9, segment_rows=segment_rows)
        got = by_event(events)
        assert set(got) == set(want)
        for e, v in want.items():
            assert got[e] == pytest.approx(v, abs=1e-6)
    final = {r["player_id"]: r["elo"] for r in state.collect()}
    for p in "abcde":
        last = [e for e in want if e[1] == p][-1]
        assert final[p] == pytest.approx(want[last][0] + want[last][2], abs=1e-6)


def test_a_busy_player_is_rated_in_blocks_of_days(spark):
    """Sixty matches of one player in one period: no block takes more sweeps than its matches, whatever the period's."""
    rnd = random.Random(9)
    matches = [(f"m{i}", 0, *rnd.sample(["hot", f"p{rnd.randrange(6)}"], 2), rnd.choice(["Hard", "Clay"]), 32.0) for i in range(60)]
    want, rows = elo_loop(matches), rating_rows(spark, matches)
    blocks = ratings.day_blocks(rows, 20).groupBy("block").count().collect()
    assert sorted(r["block"] for r in blocks) == [1, 2, 3] and {r["count"] for r in blocks} == {4}
    events = ratings.sequential_ratings(rows, tolerance=1e-9, most=20)[0].cache()
    got = by_event(events)
    assert set(got) == set(want)
    for e, v in want.items():
        assert got[e] == pytest.approx(v, abs=1e-6)
    assert {r["block"] for r in events.filter("sweeps <= 25").select("block").distinct().collect()} == {1, 2, 3} and events.filter("sweeps > 25").isEmpty()
    assert {r[0] for r in ratings.day_blocks(rows, 100).select("block").collect()} == {1}
    assert ratings.day_blocks(rows.withColumn("day", F.when(F.col("b") > 4, F.col("day"))), 20).filter("day IS NULL").isEmpty()


def test_period_ratings_meet_the_loop_only_without_repeats(spark):
    once = [("m1", 1, "a", "b", "Hard", 32.0), ("m2", 1, "c", "d", "Hard", 32.0), ("m3", 2, "a", "c", "Clay", 32.0), ("m4", 2, "b", "d", "Hard", 32.0)]
    got = by_event(ratings.period_ratings(rating_rows(spark, once))[0])
    for e, v in elo_loop(once).items():
        assert got[e] == pytest.approx(v, abs=1e-9)
    twice = [("m1", 1, "a", "b", "Hard", 32.0), ("m2", 1, "a", "b", "Hard", 32.0)]
    got = by_event(ratings.period_ratings(rating_rows(spark, twice))[0])
    assert got[("m2", "a")][0] == 1500.0 and elo_loop(twice)[("m2", "a")][0] > 1500.0


def test_tours_are_rated_apart(spark):
    once = [("m1", 1, "a", "b", "Hard", 32.0), ("m2", 2, "a", "c", "Clay", 32.0)]
    other = [("m1", 1, "c", "a", "Hard", 32.0), ("m2", 2, "b", "a", "Clay", 32.0)]
    both = rating_rows(spark, once).unionByName(rating_rows(spark, other, "wta"))
    for rated in (ratings.period_ratings(both), ratings.sequential_ratings(both)):
        events, state = rated
        for tour, matches in (("atp", once), ("wta", other)):
            got = by_event(events.filter(F.col("tour") == tour))
            for e, v in elo_loop(matches).items():
                assert got[e] == pytest.approx(v, abs=1e-6)
        assert ratings.rating_snapshot(state).filter("player_id = 'a' AND surface = 'ALL'").count() == 2
    assert ratings.sequential_ratings(both.limit(0))[0].count() == 0


def test_rating_changes_sum_to_zero(spark):
    rnd = random.Random(6)
    matches = [(f"m{i}", i // 10, *rnd.sample("abcdef", 2), "Hard", 32.0) for i in range(30)]
    events, _ = ratings.period_ratings(rating_rows(spark, matches))
    assert events.groupBy("match_key").agg(F.abs(F.sum("change")).alias("s")).agg(F.max("s")).first()[0] < 1e-9


def test_resolution_stages(spark):
    pool = spark.createDataFrame([(1, "Roger", "Federer"), (2, "Rafael", "Nadal"), (3, "Ann", "Li"), (4, "Amy", "Li")],
                                 "entity_id long, first_name string, last_name string")
    raw = spark.createDataFrame([("roger federer",), ("Nadal R.",), ("R. Nadal",), ("Roger Fedrer",), ("Li A.",), ("Nobody Here",), ("The King",), (None,)], "raw string")
    overrides = spark.createDataFrame([("the king", "Rafael Nadal")], "raw string, canonical string")
    got = {r["raw"]: (r["entity_id"], r["stage"]) for r in resolve.resolve_names(raw, "raw", pool, overrides).collect()}
    assert got == {"roger federer": (1, "exact"), "Nadal R.": (2, "block"), "R. Nadal": (2, "block"), "Roger Fedrer": (1, "near"),
                   "Li A.": (3, "block"), "Nobody Here": (None, "open"), "The King": (2, "override")}


def test_h2h_before_counts_strictly_earlier_days(spark):
    d = dt.date
    results = spark.createDataFrame([("1", "2", d(2020, 1, 1), "Hard"), ("2", "1", d(2020, 1, 5), "Clay"), ("1", "2", d(2020, 1, 9), "Hard")],
                                    "winner_id string, loser_id string, match_date date, surface string")
    events = spark.createDataFrame([("e", "2", "1", d(2020, 1, 9), "Hard"), ("f", "2", "7", d(2020, 1, 9), "Hard")],
                                   "match_key string, p1_id string, p2_id string, match_date date, surface string")
    got = {r["match_key"]: r for r in asof.h2h_before(events, results).collect()}
    assert (got["e"]["h2h_p1_wins"], got["e"]["h2h_p2_wins"], got["e"]["h2h_surface_p2_wins"]) == (1, 1, 1)
    assert got["f"]["h2h_total"] == 0 and got["f"]["h2h_p1_win_pct"] == 0.5


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, t string, v double")
    new = spark.createDataFrame([(2, None, 2.4), (3, "c", 3.0)], "k int, t string, v double")
    assert sorted(tuple(r) for r in merge.upsert(old, new, ["k"], ["t"]).collect()) == [(1, "a", 1.0), (2, "b", 2.4), (3, "c", 3.0)]
    assert [r["k"] for r in keyed.changed_rows(old, new, "k", {"v": "int"}).collect()] == [3]
    assert {r["k"] for r in keyed.changed_rows(old, new, "k", {"t": "text"}).collect()} == {2, 3}


def test_refuses_in_sample_windows(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")
    with pytest.raises(ValueError):
        keyed.refuse_in_sample(df, "d", "2020-06-01")


def test_models_learn_and_report(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        x = rnd.gauss(0, 1)
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i // 10), 1, i, x, rnd.gauss(0, 1), int(rnd.random() < 1 / (1 + np.exp(-2 * x)))))
    df = spark.createDataFrame(rows, "d date, t int, n int, x double, z double, y int").cache()
    models = {k: learning.fit(df, ["x", "z"], "y", ["d", "t", "n"], k) for k in ("logreg", "elasticnet", "ridge", "boosted")}
    scored = learning.score(models, df, ["y"])
    for k in models:
        good = scored.agg(F.avg(((F.col(f"{k}_prob") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
        assert good > 0.7
    top = {r["model"]: r["feature"] for r in keyed.top_per_group(
        learning.importance(models, ["x", "z"], spark), ["model"], [F.col("importance").desc()], 1).collect()}
    assert set(top.values()) == {"x"}


def test_dummy_names_are_clean_and_unique():
    names = learning.dummy_names({"c": ["a b", "a_b", "[x]"]})
    assert list(names.values()) == ["c_a_b", "c_a_b_1", "c_x", "c_nan"]


def test_boosting_goes_on_while_the_validation_rows_improve(spark):
    import math
    import random

    from boutwise.operators import learning

    rng, rows = random.Random(5), []
    for k in range(4000):
        x, z = rng.random(), rng.random()
        rows.append((k, x, z, int(rng.random() < 1 / (1 + math.exp(-12 * (x - z))))))
    model = learning.fit(spark.createDataFrame(rows, "k long, x double, z double, y int").coalesce(1), ["x", "z"], "y", ["k"], "boosted").stages[-1]
    assert 20 < model.getNumTrees < 500
    assert (model.getMaxIter(), model.getMaxDepth(), model.getStepSize()) == (500, 6, 0.05)


def test_prediction_job_compares_all_models_of_the_plan(spark, monkeypatch):
    from boutwise.catalog import QUERIES
    from boutwise.plans import train

    class Seen(Exception):
        pass

    def see(*_, specs=None, **__):
        raise Seen(sorted(specs or train.MODELS))

    monkeypatch.setattr(train, "train", see)
    with pytest.raises(Seen) as seen:
        QUERIES["j04_predict_upcoming"](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == ["boosted", "logreg", "ridge"]
