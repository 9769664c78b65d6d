"""Model inputs, fits and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.aggregates import METRICS, reals
from boutwise.catalog.registry import query
from boutwise.catalog.views import r6, real, twin
from boutwise.operators import evaluation, learning
from boutwise.session import materialize

NUMERIC = ["w_svpt", "w_stat", "l_stat", "w_stat2"]
CATS = ["surface", "level"]
CUT = "match_date < DATE '1999-01-01'"
ORDER = ["match_date", "tourney_id", "match_num"]
FEATURES = ["prob_a", "dq", "is_a", "is_n"]


def inputs(spark, folder):
    return views.bouts(spark, folder).withColumn("level", F.when(F.col("tourney_id") % 11 != 0, F.col("level_code")))


@query("h01_prepare_features", twin(["bouts"], f""", md AS (SELECT median(CASE WHEN match_num % 13 NOT IN (1, 5, 7) THEN w_svpt END) AS a, median(w_stat) AS b, median(l_stat) AS c, median(w_stat2) AS d FROM bouts WHERE {CUT})
SELECT match_key, {r6('coalesce(CASE WHEN match_num % 13 NOT IN (1, 5, 7) THEN w_svpt END, a)')} AS w_svpt, {r6('coalesce(w_stat, b)')} AS w_stat, {r6('coalesce(l_stat, c)')} AS l_stat, {r6('coalesce(w_stat2, d)')} AS w_stat2,
 surface, CASE WHEN tourney_id % 11 <> 0 THEN level_code ELSE 'Unknown' END AS level FROM bouts, md"""))
def prepare_features(spark, folder):
    """One input comes as text in which some numbers are missing by the words that files use for it."""
    words = F.element_at(F.create_map(F.lit(1), F.lit("nan"), F.lit(5), F.lit(" NaN "), F.lit(7), F.lit("-Infinity")), (F.col("match_num") % 13).cast("int"))
    rows = inputs(spark, folder).withColumn("w_svpt", F.coalesce(words, F.col("w_svpt").cast("string")))
    medians = learning.train_medians(rows.filter(CUT), NUMERIC)
    return reals(learning.prepare_features(rows, NUMERIC, CATS, medians), *NUMERIC).select("match_key", *NUMERIC, *CATS)


@query("h02_one_hot_to_schema", twin(["bouts"], """, o AS (SELECT match_key, match_date, CASE WHEN match_date >= DATE '1999-01-01' AND tourney_id % 3 = 0 THEN 'new' ELSE surface END AS s,
 CASE WHEN tourney_id % 11 <> 0 THEN level_code ELSE 'Unknown' END AS l FROM bouts)
SELECT match_key, CAST(s = 'A' AS INT) AS "surface_A", CAST(s = 'N' AS INT) AS "surface_N", CAST(s = 'R' AS INT) AS "surface_R", 0 AS surface_nan,
 CAST(l = '1-URGENT' AS INT) AS "level_1-URGENT", CAST(l = '2-HIGH' AS INT) AS "level_2-HIGH", CAST(l = '3-MEDIUM' AS INT) AS "level_3-MEDIUM",
 CAST(l = '4-NOT SPECIFIED' AS INT) AS "level_4-NOT_SPECIFIED", CAST(l = '5-LOW' AS INT) AS "level_5-LOW", CAST(l = 'Unknown' AS INT) AS "level_Unknown", 0 AS level_nan FROM o"""))
def one_hot_to_schema(spark, folder):
    rows = learning.prepare_features(inputs(spark, folder), [], CATS, {})
    levels = learning.category_levels(rows.filter(CUT), CATS)
    late = (F.col("match_date") >= "1999-01-01") & (F.col("tourney_id") % 3 == 0)
    hot, names = learning.one_hot(rows.withColumn("surface", F.when(late, "new").otherwise(F.col("surface"))), levels)
    return hot.select("match_key", *[F.col(f"`{n}`") for n in names])


@query("h03_scale", twin(["bouts"], f""", st AS (SELECT avg(w_svpt) AS m1, stddev_pop(w_svpt) AS s1, avg(w_stat2) AS m2, stddev_pop(w_stat2) AS s2 FROM bouts WHERE {CUT})
SELECT match_key, {r6('(w_svpt - m1) / s1')} AS w_svpt, {r6('(w_stat2 - m2) / s2')} AS w_stat2 FROM bouts, st"""))
def scale(spark, folder):
    rows = views.bouts(spark, folder)
    return reals(learning.scale(rows, learning.scaling(rows.filter(CUT), ["w_svpt", "w_stat2"])), "w_svpt", "w_stat2").select("match_key", "w_svpt", "w_stat2")


def modelled(spark, folder):
    """Scored matches with numeric inputs, stored because every fit reads them."""
    s = views.scored(spark, folder).withColumns({
        "is_a": (F.col("surface") == "A").cast("int"), "is_n": (F.col("surface") == "N").cast("int")})
    return materialize(s.select("match_key", *ORDER, *FEATURES, "p1_wins"))


def _fits(spark, folder, specs):
    rows = modelled(spark, folder)
    train = rows.filter(CUT)
    return rows.filter(f"NOT ({CUT})"), {n: learning.fit(train, FEATURES, "p1_wins", ORDER, **spec) for n, spec in specs.items()}


def _sound(rows, by):
    """Row counts, and whether the metrics lie where metrics can: what a fit's report has to hold whatever the solver."""
    inside = F.col("accuracy").between(0, 1) & F.col("brier").between(0, 1) & (F.col("log_loss") >= 0) & (F.col("log_loss") < 20)
    return rows.select(*by, "n", inside.alias("in_bounds"))


def _counted(models):
    names = ", ".join(f"('{m}')" for m in models)
    return twin(["scored"], f" SELECT model, count(*) AS n, true AS in_bounds FROM scored, (VALUES {names}) t(model) WHERE NOT ({CUT}) GROUP BY 1")


# The position rule of sliding folds: n rows in match order, three folds, at least 300 and 75 rows.
FOLDS_SQL = """, z AS (SELECT count(*) AS n, greatest(75, count(*) // 7) AS size FROM scored), y AS (SELECT n, size, greatest(300, 4 * size) AS past FROM z),
fo AS (SELECT back, size, n - back * size AS stop FROM y, (VALUES (0), (1), (2)) t(back) WHERE n - back * size - size - past >= 0),
fn AS (SELECT CAST(row_number() OVER (ORDER BY back DESC) AS INT) AS fold, size FROM fo)"""


LINEAR = {k: {"kind": k} for k in ("logreg", "elasticnet", "ridge")}
BOOSTED = {"boosted": {"kind": "boosted"}}


@query("h04_fit_linear", _counted([f"{m}_prob" for m in LINEAR]))
def fit_linear(spark, folder):
    test, models = _fits(spark, folder, LINEAR)
    scored = learning.score(models, test, ["p1_wins"]).unpivot(["p1_wins"], [f"{n}_prob" for n in models], "model", "p")
    return _sound(evaluation.metric_pack(scored, "p", "p1_wins", ["model"]), ["model"])


@query("h04_linear_optimum", "SELECT f.feature, true AS at_optimum FROM (VALUES ('intercept'), ('prob_a'), ('dq'), ('is_a'), ('is_n')) f(feature)")
def linear_optimum(spark, folder):
    """At the optimum of the unpenalised loss the errors are uncorrelated with every input: the mean gradient vanishes."""
    rows = modelled(spark, folder).filter(CUT)
    model = learning.fit(rows, FEATURES, "p1_wins", ORDER, "logreg", regParam=0.0, tol=1e-10)
    error = F.col("logreg_prob") - F.col("p1_wins")
    scored = learning.score({"logreg": model}, rows, ["p1_wins", *FEATURES])
    size = {c: F.greatest(F.avg(F.abs(F.col(c))), F.lit(1e-9)) for c in FEATURES}
    row = scored.agg(F.avg(error).alias("intercept"), *[(F.avg(error * F.col(c)) / size[c]).alias(c) for c in FEATURES])
    return row.unpivot([], ["intercept", *FEATURES], "feature", "gradient").select("feature", (F.abs("gradient") < 1e-3).alias("at_optimum"))


@query("h05_fit_boosted", _counted(["boosted"]))
def fit_boosted(spark, folder):
    test, models = _fits(spark, folder, BOOSTED)
    scored = learning.score(models, test, ["p1_wins"]).withColumn("model", F.lit("boosted"))
    return _sound(evaluation.metric_pack(scored, "boosted_prob", "p1_wins", ["model"]), ["model"])


@query("h06_score", twin(["scored"], f" SELECT match_key, true AS probabilities, true AS blended, true AS bounded FROM scored WHERE NOT ({CUT})"))
def score(spark, folder):
    from boutwise.functions.market import blend, interval

    test, models = _fits(spark, folder, {"logreg": LINEAR["logreg"], "ridge": LINEAR["ridge"]})
    rows = learning.score(models, test, ["match_key"])
    rows = rows.withColumns(blend({n: F.col(f"{n}_prob") for n in models}, {"logreg": 0.6, "ridge": 0.4}))
    rows = rows.withColumns(interval(F.col("ensemble_prob"), 0.2))
    low, high = F.greatest(F.col("ensemble_prob") - 0.2, F.lit(0.0)), F.least(F.col("ensemble_prob") + 0.2, F.lit(1.0))
    names = [c for c in rows.columns if c not in ("match_key", "logreg_prob", "ridge_prob", "ensemble_prob", "model_agreement", "confidence_tier")]
    ends = F.array_sort(F.array(*[F.col(c).cast("double") for c in names]))
    return rows.select(
        "match_key", (F.col("logreg_prob").between(0, 1) & F.col("ridge_prob").between(0, 1)).alias("probabilities"),
        (F.abs(F.col("ensemble_prob") - 0.6 * F.col("logreg_prob") - 0.4 * F.col("ridge_prob")) < 1e-9).alias("blended"),
        (F.exists(ends, lambda x: F.abs(x - low) < 1e-9) & F.exists(ends, lambda x: F.abs(x - high) < 1e-9)).alias("bounded"))


@query("h07_importance", "SELECT m.model, f.feature, true AS non_negative FROM (VALUES ('logreg'), ('boosted')) m(model), (VALUES ('prob_a'), ('dq'), ('is_a'), ('is_n')) f(feature)")
def importance(spark, folder):
    _, models = _fits(spark, folder, {"logreg": LINEAR["logreg"], **BOOSTED})
    return learning.importance(models, FEATURES, spark).select("model", "feature", (F.col("importance") >= 0).alias("non_negative"))


@query("h08_temporal_cv", twin(["scored"], FOLDS_SQL + " SELECT model, fold, size AS n, true AS in_bounds FROM fn, (VALUES ('logreg_prob'), ('ridge_prob')) m(model)"))
def temporal_cv(spark, folder):
    rows = modelled(spark, folder)
    specs = {"logreg": LINEAR["logreg"], "ridge": LINEAR["ridge"]}
    out = learning.temporal_cv(rows, FEATURES, "p1_wins", ORDER, specs)
    long = out.unpivot(["fold", "p1_wins"], [f"{n}_prob" for n in specs], "model", "p")
    return _sound(evaluation.metric_pack(long, "p", "p1_wins", ["model", "fold"]), ["model", "fold"])


_MIX = [("a", "a", 1.0, None, 0.0), ("b", "b", 1.0, None, 0.0), ("c", "c", 1.0, None, 0.0)] + [
    (f"{x}{i}_{y}{100 - i}", x, i / 100, y, (100 - i) / 100) for x, y in (("a", "b"), ("a", "c"), ("b", "c")) for i in (50, 70, 30)]
_MIX_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS candidate, fold, y, CAST({w} * {x}{f' + {v} * {z}' if z else ''} AS DOUBLE) AS p FROM s" for n, x, w, z, v in _MIX
) + " UNION ALL SELECT 'a_b_c_equal', fold, y, a / 3.0 + b / 3.0 + c / 3.0 FROM s"


@query("h09_ensemble_sweep", twin(["scored"], f""", s AS (SELECT year(match_date) AS fold, p1_wins AS y, prob_a AS a, prob_b AS b, 0.9 * prob_a + 0.05 AS c FROM scored), x AS ({_MIX_SQL}),
f AS (SELECT candidate, fold, {METRICS[0]} AS accuracy, {METRICS[1]} AS log_loss, {METRICS[2]} AS brier FROM x GROUP BY 1, 2),
g AS (SELECT candidate, count(*) AS folds, avg(log_loss) AS l, avg(brier) AS b, avg(accuracy) AS a FROM f GROUP BY 1)
SELECT candidate, folds, {r6('l')} AS log_loss_mean, {r6('b')} AS brier_mean, {r6('a')} AS accuracy_mean, rank() OVER (ORDER BY l) = 1 AS winner FROM g"""))
def ensemble_sweep(spark, folder):
    s = views.scored(spark, folder).select(
        F.year("match_date").alias("fold"), F.col("p1_wins").alias("y"), F.col("prob_a").alias("a"), F.col("prob_b").alias("b"),
        (0.9 * F.col("prob_a") + 0.05).alias("c"))
    out = learning.ensemble_sweep(s, ["a", "b", "c"], "y", "fold")
    return reals(out, "log_loss_mean", "brier_mean", "accuracy_mean").select(
        "candidate", "folds", "log_loss_mean", "brier_mean", "accuracy_mean", "winner")


@query("h10_param_grid", twin(["scored"], """, z AS (SELECT count(*) AS n, greatest(75, count(*) // 6) AS size FROM scored), y AS (SELECT n, size, greatest(300, 4 * size) AS past FROM z),
fo AS (SELECT back FROM y, (VALUES (0), (1)) t(back) WHERE n - back * size - size - past >= 0)
SELECT setting, count(*) AS folds, true AS ranked FROM fo, (VALUES ('light_prob'), ('heavy_prob')) s(setting) GROUP BY 1"""))
def param_grid(spark, folder):
    grid = {n: {"kind": "logreg", "regParam": r} for n, r in (("light", 0.001), ("heavy", 0.1))}
    out = learning.param_grid(modelled(spark, folder), FEATURES, "p1_wins", ORDER, grid, folds=2)
    return out.select("setting", "folds", (F.col("rank").between(1, 2) & (F.col("winner") == (F.col("rank") == 1))).alias("ranked"))


PENALTIES = {"a_none": 0.0, "b_light": 0.3, "c_heavy": 3.0, "d_most": 30.0}


@query("h10_halving_search", twin(["scored"], FOLDS_SQL + """, la AS (SELECT max(fold) AS last FROM fn),
st AS (SELECT * FROM (VALUES ('a_none', 1), ('b_light', 2), ('c_heavy', 3), ('d_most', 4)) s(setting, place))
SELECT fold, setting, size AS n, CAST(place AS INT) AS place, place <= CASE WHEN fold = last THEN 1 WHEN fold = 1 THEN 2 ELSE 1 END AS kept, setting = 'a_none' OR NULL AS below_base
FROM fn, la, st WHERE place <= CASE fold WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END"""))
def halving_search(spark, folder):
    """One input tells the winner in most rows, so that a heavier penalty is a greater loss and the order of the settings is known."""
    rows = modelled(spark, folder).withColumn("hint", F.when(F.col("match_num") % 5 == 0, 1 - F.col("p1_wins")).otherwise(F.col("p1_wins")))
    out = learning.halving_search(rows, [*FEATURES, "hint"], "p1_wins", ORDER, {n: {"kind": "logreg", "regParam": r} for n, r in PENALTIES.items()})
    return out.select("fold", "setting", "n", "place", "kept", F.when(F.col("setting") == "a_none", F.col("log_loss") < 0.6).alias("below_base"))


@query("h11_walk_forward", twin(["scored"], """ SELECT year(match_date) AS period, count(*) AS n, CAST(sum(p1_wins) AS BIGINT) AS wins, true AS in_bounds FROM scored
WHERE year(match_date) > (SELECT min(year(match_date)) FROM scored) GROUP BY 1"""))
def walk_forward(spark, folder):
    """Fits per year."""
    out = learning.walk_forward(
        modelled(spark, folder), FEATURES, "p1_wins", ORDER, F.year("match_date"), "logreg", ["match_key", "p1_wins"])
    return out.groupBy(F.col("period").cast("bigint").alias("period")).agg(
        F.count("*").alias("n"), F.sum("p1_wins").cast("bigint").alias("wins"), F.bool_and(F.col("logreg_prob").between(0, 1)).alias("in_bounds"))


@query("h12_train_report", twin(["scored"], f""", mm AS (SELECT 'a' AS model, p1_wins AS y, prob_a AS p FROM scored UNION ALL SELECT 'b', p1_wins, prob_b FROM scored),
k AS (SELECT model, count(*) AS n, {METRICS[0]} AS accuracy, {METRICS[1]} AS log_loss FROM mm GROUP BY 1)
SELECT 'all' AS tour, '2024-01-01' AS run_at, max(n) AS n, {", ".join(f"{r6(f'''max(CASE WHEN model = '{m}' THEN {c} END)''')} AS {m}_{c}" for m in "ab" for c in ("accuracy", "log_loss"))} FROM k"""))
def train_report(spark, folder):
    s = views.scored(spark, folder).select(F.col("p1_wins").alias("y"), F.col("prob_a").alias("a"), F.col("prob_b").alias("b"))
    metrics = evaluation.metric_pack(s.unpivot(["y"], ["a", "b"], "model", "p"), "p", "y", ["model"])
    out = learning.train_report(metrics, "all", "2024-01-01")
    names = [f"{m}_{c}" for m in "ab" for c in ("accuracy", "log_loss")]
    return reals(out, *names).select("tour", "run_at", "n", *names)
