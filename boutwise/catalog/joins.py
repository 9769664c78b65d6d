"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutwise.catalog import views
from boutwise.catalog.registry import query
from boutwise.catalog.sources import NEW, OLD, versions
from boutwise.catalog.views import r6, real, twin
from boutwise.operators import asof, features, keyed, marketplace, resolve
from boutwise.session import materialize


@query("c01_changed_rows", f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT n.* FROM n LEFT JOIN o ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR coalesce(n.o_orderstatus, '') <> coalesce(o.o_orderstatus, '') OR round_even(n.o_totalprice, 0) <> round_even(o.o_totalprice, 0)""")
def changed_rows(spark, folder):
    old, new = versions(spark, folder)
    return keyed.changed_rows(old, new, "o_orderkey", {"o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "int", "o_orderpriority": "text"})


@query("c02_new_only", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_orderkey = n.o_orderkey)")
def new_only(spark, folder):
    old, new = versions(spark, folder)
    return keyed.new_only(new, old, ["o_orderkey"])


@query("c03_rating_lookup", twin(["pm"], f"""SELECT match_key, player_id, {r6("CASE WHEN s_suppkey % 3 <> 0 THEN 1500 + s_acctbal / 100 ELSE 1500.0 END")} AS elo_overall,
 {r6("CASE WHEN s_suppkey % 3 <> 0 THEN 1500 + s_acctbal / 200 ELSE 1500.0 END")} AS elo_surface FROM pm JOIN supplier ON s_suppkey = player_id"""))
def rating_lookup(spark, folder):
    """Both tours rate all players under the same match keys; only the own tour's ratings count."""
    rows = views.pm(spark, folder).withColumn("tour", F.lit("atp"))
    s = views.table(spark, folder, "supplier").filter("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").alias("player_id"), (1500 + F.col("s_acctbal") / 100).alias("elo_pre"), (1500 + F.col("s_acctbal") / 200).alias("surface_elo_pre"))
    known = rows.select("tour", "match_key", "player_id").join(s, "player_id")
    known = known.unionByName(known.withColumns({"tour": F.lit("wta"), "elo_pre": F.col("elo_pre") + 500.0}))
    return features.rating_lookup(rows, known, ["tour", "match_key", "player_id"]).select(
        "match_key", "player_id", real("elo_overall").alias("elo_overall"), real("elo_surface").alias("elo_surface"))


@query("c04_lookup_two_level", """WITH e AS (SELECT c_name AS k, max(c_nationkey) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
l AS (SELECT translate(lower(replace(c_name, '#', '-')), '-', ' ') AS k, max(c_nationkey) AS v FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1)
SELECT c_custkey, CAST(coalesce(e.v, l.v) AS VARCHAR) AS country FROM customer LEFT JOIN e ON e.k = CASE WHEN c_custkey % 3 = 1 THEN upper(replace(c_name, '#', '_')) ELSE c_name END
 LEFT JOIN l ON l.k = translate(lower(CASE WHEN c_custkey % 3 = 1 THEN upper(replace(c_name, '#', '_')) ELSE c_name END), '.-_/''', '     ')""")
def lookup_two_level(spark, folder):
    c = views.table(spark, folder, "customer")
    pairs = c.filter("c_custkey % 3 < 2").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.translate("c_name", "#", "-")).alias("key"),
        F.col("c_nationkey").cast("string").alias("value"))
    named = c.withColumn("name", F.when(F.col("c_custkey") % 3 == 1, F.upper(F.translate("c_name", "#", "_"))).otherwise(F.col("c_name")))
    return keyed.lookup_two_level(named, "name", pairs, "country").select("c_custkey", "country")


# Two snapshots per match and maker, sides swapped now and then, ids missing now and then.
QUOTES = """SELECT match_date, CASE WHEN tourney_id % 3 = 0 THEN p2_id ELSE p1_id END AS a_id, CASE WHEN tourney_id % 3 = 0 THEN p1_id ELSE p2_id END AS b_id,
 tourney_id % 5 = 0 AS no_ids, CASE WHEN tourney_id % 3 = 0 THEN odds_p2 ELSE odds_p1 END AS oa, CASE WHEN tourney_id % 3 = 0 THEN odds_p1 ELSE odds_p2 END AS ob,
 tourney_id, match_num FROM {scored}"""
MAKERS = """, qt AS (""" + QUOTES.format(scored="scored") + """),
mk AS (SELECT * FROM (VALUES (1, 'maker_a', 0.0, 10), (2, 'maker_b', 0.02, 20), (3, 'maker_c', 0.05, 20), (4, 'flashscore_event_page', 0.01, 20), (5, 'maker_a', -5.0, 20)) t(i, bookmaker, shift, hour)),
od AS (SELECT match_date, tourney_id, a_id, b_id, no_ids, bookmaker, oa + shift AS oa, ob + shift AS ob, hour FROM qt, mk WHERE tourney_id % 7 <> 0 AND (i < 4 OR match_num = 1))"""


def quotes(spark, folder, scored=None):
    q = (views.scored(spark, folder) if scored is None else scored).withColumn("swap", F.col("tourney_id") % 3 == 0)
    q = q.select(
        "match_date", "tourney_id", "match_num", (F.col("tourney_id") % 5 == 0).alias("no_ids"),
        *[F.when(F.col("swap"), F.col(y)).otherwise(F.col(x)).alias(n)
          for n, x, y in (("a_id", "p1_id", "p2_id"), ("b_id", "p2_id", "p1_id"), ("oa", "odds_p1", "odds_p2"), ("ob", "odds_p2", "odds_p1"))])
    makers = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(b).alias("bookmaker"), F.lit(s).alias("shift"), F.lit(h).alias("hour"))
        for i, b, s, h in ((1, "maker_a", 0.0, 10), (2, "maker_b", 0.02, 20), (3, "maker_c", 0.05, 20), (4, "flashscore_event_page", 0.01, 20), (5, "maker_a", -5.0, 20))])
    rows = q.filter("tourney_id % 7 <> 0").select("*", F.explode(makers).alias("m")).filter((F.col("m.i") < 4) | (F.col("match_num") == 1))
    return rows.select(
        "match_date", "tourney_id", "a_id", "b_id", "no_ids", "m.bookmaker", (F.col("oa") + F.col("m.shift")).alias("oa"),
        (F.col("ob") + F.col("m.shift")).alias("ob"), F.col("m.hour").alias("hour"))


@query("c05_join_pred_odds", twin(["scored"], MAKERS + f""", al AS (SELECT match_date, no_ids, least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, least('n' || a_id, 'n' || b_id) AS nlo, greatest('n' || a_id, 'n' || b_id) AS nhi,
  a_id, b_id, oa, ob, bookmaker, hour, 't' || tourney_id % 5 AS tn FROM od),
byid AS (SELECT match_date, lo, hi, CASE WHEN a_id <= b_id THEN oa ELSE ob END AS o1, CASE WHEN a_id <= b_id THEN ob ELSE oa END AS o2, bookmaker, hour, tn,
  max(hour) OVER (PARTITION BY match_date, lo, hi) AS mh FROM al WHERE NOT no_ids),
gi AS (SELECT match_date, lo, hi, count(*) AS any_rows, median(CASE WHEN o1 > 1 AND o2 > 1 THEN o1 END) AS o1, median(CASE WHEN o1 > 1 AND o2 > 1 THEN o2 END) AS o2,
  count(DISTINCT CASE WHEN o1 > 1 AND o2 > 1 AND bookmaker <> 'flashscore_event_page' THEN bookmaker END) AS nm, count_if(o1 > 1 AND o2 > 1) AS pairs, min(CASE WHEN o1 > 1 AND o2 > 1 THEN tn END) AS tn FROM byid WHERE hour = mh GROUP BY 1, 2, 3),
byname AS (SELECT match_date, nlo, nhi, CASE WHEN 'n' || a_id <= 'n' || b_id THEN oa ELSE ob END AS o1, CASE WHEN 'n' || a_id <= 'n' || b_id THEN ob ELSE oa END AS o2, bookmaker, hour, tn,
  max(hour) OVER (PARTITION BY match_date, nlo, nhi) AS mh FROM al),
gn AS (SELECT match_date, nlo, nhi, median(CASE WHEN o1 > 1 AND o2 > 1 THEN o1 END) AS o1, median(CASE WHEN o1 > 1 AND o2 > 1 THEN o2 END) AS o2,
  count(DISTINCT CASE WHEN o1 > 1 AND o2 > 1 AND bookmaker <> 'flashscore_event_page' THEN bookmaker END) AS nm, count_if(o1 > 1 AND o2 > 1) AS pairs, min(CASE WHEN o1 > 1 AND o2 > 1 THEN tn END) AS tn FROM byname WHERE hour = mh GROUP BY 1, 2, 3),
j AS (SELECT match_key, CASE WHEN gi.any_rows IS NOT NULL THEN gi.o1 WHEN 'n' || p1_id <= 'n' || p2_id THEN gn.o1 ELSE gn.o2 END AS odds_p1,
  CASE WHEN gi.any_rows IS NOT NULL THEN gi.o2 WHEN 'n' || p1_id <= 'n' || p2_id THEN gn.o2 ELSE gn.o1 END AS odds_p2,
  CASE WHEN gi.any_rows IS NOT NULL THEN CASE WHEN gi.nm > 0 THEN gi.nm ELSE gi.pairs END ELSE CASE WHEN gn.nm > 0 THEN gn.nm ELSE gn.pairs END END AS bookmaker_count,
  CASE WHEN CASE WHEN gi.any_rows IS NOT NULL THEN gi.pairs ELSE gn.pairs END > 1 THEN 'median' ELSE 'single_source' END AS aggregation_method,
  CASE WHEN gi.any_rows IS NOT NULL THEN gi.tn ELSE gn.tn END AS tournament
 FROM scored s LEFT JOIN gi ON gi.match_date = s.match_date AND gi.lo = p1_id AND gi.hi = p2_id
  LEFT JOIN gn ON gn.match_date = s.match_date AND gn.nlo = least('n' || p1_id, 'n' || p2_id) AND gn.nhi = greatest('n' || p1_id, 'n' || p2_id))
SELECT match_key, {r6('odds_p1')} AS odds_p1, {r6('odds_p2')} AS odds_p2, CAST(bookmaker_count AS BIGINT) AS bookmaker_count, aggregation_method, tournament, 'on ' || tournament AS surface FROM j WHERE odds_p1 IS NOT NULL AND bookmaker_count >= 2"""))
def join_pred_odds(spark, folder):
    """Names are written in two ways, and some odds use an alias."""
    n, old = F.lit("J.-W. "), F.col("a_id") % 3 == 0
    written = F.when(old, F.concat(F.lit("Old "), "a_id")).otherwise(F.concat(F.lit("j w "), "a_id"))
    aliases = views.table(spark, folder, "supplier").filter("s_suppkey % 3 = 0").select(
        F.concat(F.lit("OLD "), "s_suppkey").alias("alias"), F.concat(n, "s_suppkey").alias("canonical"))
    scored = materialize(views.scored(spark, folder).select("match_key", "match_date", "tourney_id", "match_num", "p1_id", "p2_id", "odds_p1", "odds_p2"))
    pred = scored.select(
        "match_key", "match_date", "p1_id", "p2_id", F.concat(n, "p1_id").alias("p1_name"), F.concat(n, "p2_id").alias("p2_name"))
    odds = quotes(spark, folder, scored).select(
        "match_date", F.col("hour").alias("captured_at"), "bookmaker", F.when(~F.col("no_ids"), F.col("a_id")).alias("o1_id"),
        F.when(~F.col("no_ids"), F.col("b_id")).alias("o2_id"), written.alias("o1_name"), F.concat(n, "b_id").alias("o2_name"),
        F.col("oa").alias("odds_p1"), F.col("ob").alias("odds_p2"), F.concat(F.lit("t"), F.col("tourney_id") % 5).alias("tournament"),
        F.concat(F.lit("on t"), F.col("tourney_id") % 5).alias("surface"))
    return marketplace.join_predictions(pred, odds, min_bookmakers=2, aliases=aliases).select(
        "match_key", real("odds_p1").alias("odds_p1"), real("odds_p2").alias("odds_p2"), "bookmaker_count", "aggregation_method", "tournament", "surface")


@query("c06_asof_previous", twin(["odds"], f"""SELECT c.snapshot_id, max(p.captured_at) AS prev_captured_at, {r6('arg_max(p.odds_p1, p.captured_at)')} AS prev_odds_p1
FROM odds c LEFT JOIN odds p ON p.match_id = c.match_id AND p.captured_at < c.captured_at AND p.snapshot_id % 3 = 0 WHERE c.snapshot_id % 3 <> 0 GROUP BY 1"""))
def asof_previous(spark, folder):
    o = views.odds(spark, folder)
    rows = marketplace.asof_previous(
        o.filter("snapshot_id % 3 <> 0").select("snapshot_id", "match_id", "captured_at"), o.filter("snapshot_id % 3 = 0"),
        ["match_id"], "captured_at", ["odds_p1"])
    return rows.select("snapshot_id", "prev_captured_at", real("prev_odds_p1").alias("prev_odds_p1"))


UPCOMING = """, up AS (SELECT match_key, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id, match_date, surface FROM bouts WHERE match_date >= DATE '1999-01-01')"""


def upcoming(spark, folder):
    return views.bouts(spark, folder).filter("match_date >= DATE '1999-01-01'").select(
        "match_key", F.least("winner_id", "loser_id").alias("p1_id"), F.greatest("winner_id", "loser_id").alias("p2_id"), "match_date", "surface")


@query("c07_h2h_asof", twin(["bouts"], UPCOMING + f""", j AS (SELECT up.match_key, count(b.match_key) AS t, count(CASE WHEN b.winner_id = p1_id THEN 1 END) AS w1, count(CASE WHEN b.winner_id = p2_id THEN 1 END) AS w2,
  count(CASE WHEN b.winner_id = p1_id AND b.surface = up.surface THEN 1 END) AS s1, count(CASE WHEN b.winner_id = p2_id AND b.surface = up.surface THEN 1 END) AS s2
 FROM up LEFT JOIN bouts b ON least(b.winner_id, b.loser_id) = p1_id AND greatest(b.winner_id, b.loser_id) = p2_id AND b.match_date < up.match_date GROUP BY 1)
SELECT match_key, CAST(w1 AS BIGINT) AS h2h_p1_wins, CAST(w2 AS BIGINT) AS h2h_p2_wins, t AS h2h_total, {r6('CASE WHEN t > 0 THEN w1 / t ELSE 0.5 END')} AS h2h_p1_win_pct,
 CAST(s1 AS BIGINT) AS h2h_surface_p1_wins, CAST(s2 AS BIGINT) AS h2h_surface_p2_wins FROM j"""))
def h2h_asof(spark, folder):
    rows = asof.h2h_before(upcoming(spark, folder), views.bouts(spark, folder).select("winner_id", "loser_id", "match_date", "surface"))
    return rows.select("match_key", "h2h_p1_wins", "h2h_p2_wins", "h2h_total", real("h2h_p1_win_pct").alias("h2h_p1_win_pct"),
                       "h2h_surface_p1_wins", "h2h_surface_p2_wins")


@query("c08_latest_state", twin(["bouts"], """, st AS (SELECT match_date, match_key, winner_id AS id, w_svpt AS svpt, w_stat AS stat FROM bouts WHERE match_date < DATE '1999-01-01' AND winner_id % 5 <> 0
  UNION ALL SELECT match_date, match_key, loser_id, l_svpt, l_stat FROM bouts WHERE match_date < DATE '1999-01-01' AND winner_id % 5 <> 0),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_date DESC, match_key DESC) AS rn FROM st) WHERE rn = 1)""" + UPCOMING + """
SELECT up.match_key, coalesce(a.svpt, 7.0) AS p1_svpt, coalesce(a.stat, 0.5) AS p1_stat, coalesce(b.svpt, 7.0) AS p2_svpt, coalesce(b.stat, 0.5) AS p2_stat,
 CAST(coalesce(greatest(date_diff('day', a.match_date, up.match_date), 0), 14) AS INT) AS p1_days_since_last_match,
 CAST(coalesce(greatest(date_diff('day', b.match_date, up.match_date), 0), 14) AS INT) AS p2_days_since_last_match
FROM up LEFT JOIN la a ON a.id = p1_id LEFT JOIN la b ON b.id = p2_id"""))
def latest_state(spark, folder):
    past = views.bouts(spark, folder).filter("match_date < DATE '1999-01-01' AND winner_id % 5 <> 0").select(
        "match_date", "match_key", F.col("winner_id").alias("p1_id"), F.col("loser_id").alias("p2_id"),
        F.col("w_svpt").alias("p1_svpt"), F.col("l_svpt").alias("p2_svpt"), F.col("w_stat").alias("p1_stat"), F.col("l_stat").alias("p2_stat"))
    state = asof.latest_state(past, ["svpt", "stat"])
    out = asof.attach_state(upcoming(spark, folder), state, {"svpt": 7.0, "stat": 0.5})
    return out.select("match_key", *[f"{p}_{c}" for p in ("p1", "p2") for c in ("svpt", "stat", "days_since_last_match")])


@query("c09_semi_any_date", twin(["bouts"], """, ev AS (SELECT match_key, least(winner_id, loser_id) AS lo, greatest(winner_id, loser_id) AS hi, match_date + CAST(match_num % 3 AS INT) AS event_date,
  match_date + CAST(tourney_id % 5 AS INT) - 1 AS tourney_date FROM bouts),
kn AS (SELECT DISTINCT match_date AS d, least(winner_id, loser_id) AS lo, greatest(winner_id, loser_id) AS hi FROM bouts WHERE tourney_id % 6 <> 0),
cd AS (SELECT match_key, lo, hi, event_date, tourney_date, 0 AS pr, CAST(tourney_date AS DATE) AS d FROM ev UNION ALL SELECT match_key, lo, hi, event_date, tourney_date, 1, CAST(date_trunc('week', tourney_date) AS DATE) FROM ev
  UNION ALL SELECT match_key, lo, hi, event_date, tourney_date, 2, CAST(event_date AS DATE) FROM ev)
SELECT match_key, arg_min(cd.d, pr) AS stored_date FROM cd JOIN kn ON kn.d = cd.d AND kn.lo = cd.lo AND kn.hi = cd.hi GROUP BY match_key"""))
def semi_any_date(spark, folder):
    b = views.bouts(spark, folder)
    low, high = F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")
    ev = b.select(
        "match_key", low.alias("p1_id"), high.alias("p2_id"), F.date_add("match_date", (F.col("match_num") % 3).cast("int")).alias("event_date"),
        F.date_add("match_date", (F.col("tourney_id") % 5).cast("int") - 1).alias("tourney_date"))
    known = b.filter("tourney_id % 6 <> 0").select("match_date", low.alias("p1_id"), high.alias("p2_id"))
    return asof.known_on_some_date(ev, known).select("match_key", "stored_date")


@query("c10_remap_ids", twin(["bouts"], """, mp AS (SELECT s_suppkey AS old_id, 's' || s_suppkey AS new_id FROM supplier WHERE s_suppkey % 4 <> 1)
SELECT match_date, tourney_id, match_num, a.new_id AS winner_id, b.new_id AS loser_id FROM bouts JOIN mp a ON a.old_id = winner_id JOIN mp b ON b.old_id = loser_id"""))
def remap_ids(spark, folder):
    mapping = views.table(spark, folder, "supplier").filter("s_suppkey % 4 <> 1").select(
        F.col("s_suppkey").alias("old_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("new_id"))
    rows = views.bouts(spark, folder).select("match_date", "tourney_id", "match_num", "winner_id", "loser_id")
    return keyed.remap_ids(rows, mapping, ["winner_id", "loser_id"])


# Names made of the customer number: letters for digits, so that they differ in more than a digit.
LETTERS = "'0123456789', 'abdeiklmno'"
FIRST = f"initcap(translate(lpad(CAST((c_custkey * 7919) % 100003 AS VARCHAR(9)), 5, '0'), {LETTERS}))"
LAST = f"initcap(translate(lpad(CAST((c_custkey * 104729) % 9999991 AS VARCHAR(9)), 7, '0'), {LETTERS}))"
FIRST_SQL, LAST_SQL = (s.replace("initcap(", "(") for s in (FIRST, LAST))
RAW_NAME = ("CASE c_custkey % 8 WHEN 0 THEN upper(f || ' ' || l) WHEN 1 THEN l || ' ' || upper(substr(f, 1, 1)) || '.' WHEN 2 THEN upper(substr(f, 1, 1)) || '. ' || l "
            "WHEN 3 THEN f || ' ' || substr(l, 1, 3) || 'z' || substr(l, 5) WHEN 4 THEN f || 'e ' || substr(l, 2) WHEN 5 THEN 'zz ' || reverse(l) "
            "WHEN 6 THEN 'Nick ' || CAST(c_custkey % 40 AS VARCHAR(9)) ELSE f || '-' || l END")


@query("c11_resolve_entities", f"""WITH pool AS (SELECT c_custkey AS id, {FIRST_SQL} AS f, {LAST_SQL} AS l, {FIRST_SQL} || ' ' || {LAST_SQL} AS norm FROM customer),
rw AS (SELECT DISTINCT {RAW_NAME} AS raw FROM (SELECT c_custkey, {FIRST_SQL} AS f, {LAST_SQL} AS l FROM customer)),
nm AS (SELECT raw, trim(regexp_replace(translate(lower(raw), '.-', '  '), '\\s+', ' ', 'g')) AS norm FROM rw),
bn AS (SELECT norm, arg_min(id, id) AS id FROM pool GROUP BY 1),
ov AS (SELECT 'nick ' || c_custkey AS norm, norm AS target FROM customer JOIN pool ON pool.id = c_custkey WHERE c_custkey < 20),
s0 AS (SELECT nm.raw, ov.target AS ename, bn.id, 100.0 AS score, 'override' AS stage FROM nm JOIN ov ON ov.norm = nm.norm LEFT JOIN bn ON bn.norm = ov.target),
o1 AS (SELECT nm.* FROM nm WHERE raw NOT IN (SELECT raw FROM s0)),
s1 AS (SELECT raw, o1.norm AS ename, id, 100.0 AS score, 'exact' AS stage FROM o1 JOIN bn ON bn.norm = o1.norm),
o2 AS (SELECT *, CASE WHEN regexp_matches(trim(raw), '^(.+?)\\s+([A-Za-z])\\.?$') THEN lower(regexp_extract(trim(raw), '^(.+?)\\s+([A-Za-z])\\.?$', 1))
    WHEN regexp_matches(trim(raw), '^([A-Za-z])\\.?\\s+(.+)$') THEN lower(regexp_extract(trim(raw), '^([A-Za-z])\\.?\\s+(.+)$', 2)) END AS kl,
   CASE WHEN regexp_matches(trim(raw), '^(.+?)\\s+([A-Za-z])\\.?$') THEN lower(regexp_extract(trim(raw), '^(.+?)\\s+([A-Za-z])\\.?$', 2))
    WHEN regexp_matches(trim(raw), '^([A-Za-z])\\.?\\s+(.+)$') THEN lower(regexp_extract(trim(raw), '^([A-Za-z])\\.?\\s+(.+)$', 1)) END AS ki FROM o1 WHERE raw NOT IN (SELECT raw FROM s1)),
bl AS (SELECT l, substr(f, 1, 1) AS i, count(*) AS c, min(id) AS id FROM pool GROUP BY 1, 2),
s2 AS (SELECT raw, pool.norm AS ename, bl.id, CASE WHEN c = 1 THEN 100.0 ELSE 100.0 * (1.0 - levenshtein(o2.norm, pool.norm) / greatest(length(o2.norm), length(pool.norm))) END AS score, 'block' AS stage
  FROM o2 JOIN bl ON bl.l = kl AND bl.i = ki JOIN pool ON pool.id = bl.id),
o3 AS (SELECT raw, norm FROM o2 WHERE raw NOT IN (SELECT raw FROM s2)),
nr AS (SELECT raw, bn.norm AS ename, id, 100.0 * (1.0 - levenshtein(o3.norm, bn.norm) / greatest(length(o3.norm), length(bn.norm))) AS score, levenshtein(o3.norm, bn.norm) AS d
  FROM o3 JOIN bn ON length(bn.norm) BETWEEN length(o3.norm) * 0.84 AND length(o3.norm) / 0.84),
s3 AS (SELECT raw, ename, id, score, 'near' AS stage FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, id) AS rn FROM nr WHERE score >= 85) WHERE rn = 1),
s4 AS (SELECT raw, raw AS ename, NULL AS id, 0.0 AS score, 'open' AS stage FROM o3 WHERE raw NOT IN (SELECT raw FROM s3))
SELECT raw, lower(ename) AS entity_name, CAST(id AS BIGINT) AS entity_id, round(CAST(score AS DOUBLE) + 1e-9, 6) AS score, stage FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)""")
def resolve_entities(spark, folder):
    pool = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.expr(FIRST).alias("first_name"), F.expr(LAST).alias("last_name"), "c_custkey")
    raw = pool.withColumns({"f": F.lower("first_name"), "l": F.lower("last_name")}).select(F.expr(RAW_NAME).alias("raw"))
    overrides = pool.filter("c_custkey < 20").select(
        F.concat(F.lit("nick "), "c_custkey").alias("raw"), F.lower(F.concat_ws(" ", "first_name", "last_name")).alias("canonical"))
    out = resolve.resolve_names(raw, "raw", pool.drop("c_custkey"), overrides)
    return out.select("raw", F.lower("entity_name").alias("entity_name"), "entity_id", real("score").alias("score"), "stage")


# Names with their words swapped, one dropped or one added, some with a wrong letter as well, and names of nobody.
THIRD = f"translate(lpad(CAST((c_custkey * 31) % 997 AS VARCHAR(9)), 3, '0'), {LETTERS})"
MIXED_NAME = ("CASE c_custkey % 6 WHEN 0 THEN l || ' ' || f WHEN 1 THEN l || ', ' || m || ' ' || f WHEN 2 THEN upper(l) || ' ' || f || ' ' || m || ' jr' "
              "WHEN 3 THEN l || ' ' || m || ' z' || substr(f, 2) WHEN 4 THEN m || ' ' || reverse(l) ELSE l || ' z' || substr(m, 2) || ' ' || f END")
SIMILAR = "100.0 * (1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1))"


@query("c11_resolve_any_order", f"""WITH pool AS (SELECT c_custkey AS id, {FIRST_SQL} || ' ' || {THIRD} || ' ' || {LAST_SQL} AS norm FROM customer),
rw AS (SELECT DISTINCT {MIXED_NAME} AS raw FROM (SELECT c_custkey, {FIRST_SQL} AS f, {LAST_SQL} AS l, {THIRD} AS m FROM customer)),
nm AS (SELECT raw, trim(regexp_replace(translate(lower(raw), '.-', '  '), '\\s+', ' ', 'g')) AS norm FROM rw),
bn AS (SELECT norm, min(id) AS id FROM pool GROUP BY 1),
wa AS (SELECT raw, norm, list_sort(string_split(trim(regexp_replace(norm, '[,\\s]+', ' ', 'g')), ' ')) AS a FROM nm), wb AS (SELECT id, norm, list_sort(string_split(norm, ' ')) AS b FROM bn),
sd AS (SELECT raw, norm, a, array_to_string(a, ' ') AS ta, list_sort(list_distinct(a)) AS da FROM wa), se AS (SELECT id, norm AS other, b, array_to_string(b, ' ') AS tb, list_sort(list_distinct(b)) AS db FROM wb),
cm AS (SELECT raw, norm, id, other, ta, tb, da, db, list_filter(da, lambda x: list_contains(db, x)) AS c FROM sd, se),
jn AS (SELECT *, array_to_string(c, ' ') AS tc, array_to_string(c || list_filter(da, lambda x: NOT list_contains(c, x)), ' ') AS t1, array_to_string(c || list_filter(db, lambda x: NOT list_contains(c, x)), ' ') AS t2 FROM cm),
sc AS (SELECT raw, id, other, {SIMILAR.format("norm", "other")} AS near,
  0.95 * greatest({SIMILAR.format("ta", "tb")}, CASE WHEN len(c) >= 2 THEN greatest({SIMILAR.format("tc", "t1")}, {SIMILAR.format("tc", "t2")}, {SIMILAR.format("t1", "t2")}) ELSE 0.0 END) AS free FROM jn),
b1 AS (SELECT * FROM (SELECT raw, id, other, near AS score, row_number() OVER (PARTITION BY raw ORDER BY near DESC, id) AS rn FROM sc WHERE near >= 85) WHERE rn = 1),
b2 AS (SELECT * FROM (SELECT raw, id, other, free AS score, row_number() OVER (PARTITION BY raw ORDER BY free DESC, id) AS rn FROM sc WHERE free >= 85 - 1e-9) WHERE rn = 1)
SELECT nm.raw, coalesce(b1.other, b2.other, nm.raw) AS entity_name, CAST(coalesce(b1.id, b2.id) AS BIGINT) AS entity_id, round(CAST(coalesce(b1.score, b2.score, 0.0) AS DOUBLE) + 1e-9, 6) AS score,
 CASE WHEN b1.id IS NOT NULL THEN 'near' WHEN b2.id IS NOT NULL THEN 'any order' ELSE 'open' END AS stage FROM nm LEFT JOIN b1 ON b1.raw = nm.raw LEFT JOIN b2 ON b2.raw = nm.raw""")
def resolve_any_order(spark, folder):
    """Names whose words stand in another order, or of which a word is missing, added or misspelt."""
    people = views.table(spark, folder, "customer").selectExpr("c_custkey", f"{FIRST_SQL} AS f", f"{LAST_SQL} AS l", f"{THIRD} AS m")
    pool = people.selectExpr("c_custkey AS entity_id", "f || ' ' || m AS first_name", "l AS last_name")
    out = resolve.resolve_names(people.select(F.expr(MIXED_NAME).alias("raw")), "raw", pool, any_order=True)
    return out.select("raw", "entity_name", "entity_id", real("score").alias("score"), "stage")


@query("c12_refresh_targets", """WITH ex AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0),
tg AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT o_orderkey, tg.o_custkey, day FROM tg LEFT JOIN ex ON ex.o_custkey = tg.o_custkey WHERE (day IS NULL OR day <= DATE '1998-06-01')
 AND (ex.o_custkey IS NULL OR day IS NULL OR day >= DATE '1998-06-01' - 21)""")
def refresh_targets(spark, folder):
    o = views.table(spark, folder, "orders")
    targets = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return keyed.refresh_targets(targets, o.filter("o_orderkey % 2 = 0"), "o_custkey", "day", F.lit("1998-06-01").cast("date"))


@query("c13_enrich_dims", twin(["bouts"], """SELECT match_key, a.s_name AS w_s_name, a.s_nationkey AS w_s_nationkey, b.s_name AS l_s_name, b.s_nationkey AS l_s_nationkey
FROM bouts LEFT JOIN supplier a ON a.s_suppkey = winner_id AND a.s_suppkey % 3 <> 0 LEFT JOIN supplier b ON b.s_suppkey = loser_id AND b.s_suppkey % 3 <> 0"""))
def enrich_dims(spark, folder):
    dim = views.table(spark, folder, "supplier").filter("s_suppkey % 3 <> 0")
    out = keyed.enrich_sides(views.bouts(spark, folder), dim, "s_suppkey", ["s_name", "s_nationkey"], {"w": "winner_id", "l": "loser_id"})
    return out.select("match_key", "w_s_name", "w_s_nationkey", "l_s_name", "l_s_nationkey")


@query("c14_unknown_ids", """SELECT DISTINCT id FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) WHERE id NOT IN (SELECT s_suppkey FROM supplier)""")
def unknown_ids(spark, folder):
    return keyed.unknown_ids(views.table(spark, folder, "lineitem"), ["l_suppkey", "l_partkey"], views.table(spark, folder, "supplier"), "s_suppkey")


@query("c15_long_to_wide", twin(["bouts"], """SELECT match_key, least(winner_id, loser_id) AS p1_player_id, greatest(winner_id, loser_id) AS p2_player_id,
 CASE WHEN winner_id < loser_id THEN w_stat ELSE l_stat END AS p1_stat, CASE WHEN winner_id < loser_id THEN l_stat ELSE w_stat END AS p2_stat,
 CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END AS p1_result, CASE WHEN winner_id < loser_id THEN 0 ELSE 1 END AS p2_result FROM bouts"""))
def long_to_wide(spark, folder):
    rows = views.pm(spark, folder).withColumn("side", F.when(F.col("player_id") < F.col("opponent_id"), 1).otherwise(2))
    return features.long_to_wide(rows, ["match_key"], ["match_key"], ["player_id", "stat", "result"])
