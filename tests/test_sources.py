"""Files in and out, extraction, and the two streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from boutwise.operators import marketplace
from boutwise.sources import ledger, pages, tables
from boutwise.streaming import odds as streams


def test_year_files(spark, tmp_path):
    header = ",".join(tables.RAW_COLUMNS)
    row = ["t1", "Cup"] + [""] * 4 + ["7"] + [""] * (len(tables.RAW_COLUMNS) - 7)
    for name, lines in (("atp_matches_2020.csv", 2), ("atp_matches_2021.csv", 1), ("atp_matches_quali.csv", 3), ("wta_matches_2020.csv", 4), ("atp_matches_2022.csv", 0)):
        (tmp_path / name).write_text("\n".join([header] + [",".join(row)] * lines) + "\n")
    got = tables.scan_year_files(spark, str(tmp_path), "atp")
    assert got.columns == [*tables.RAW_COLUMNS, "source", "source_file"] and len(tables.RAW_COLUMNS) == 49
    assert {(r["source_file"], r["match_num"]): 1 for r in got.collect()} == {("atp_matches_2020.csv", 7): 1, ("atp_matches_2021.csv", 7): 1}
    assert got.count() == 3


def test_year_files_are_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2001, None), ("b", 2, 2001, 'x, "y"'), ("c", 3, 1999, "ü"), ("d", 4, None, "z")], "tourney_id string, match_num int, y int, score string")
    tables.write_year_files(df.repartition(3), str(tmp_path), "atp", F.col("y"))
    got = tables.scan_year_files(spark, str(tmp_path), "atp").select(F.substring("source_file", 13, 4).alias("y"), "tourney_id", "match_num", "score", "surface")
    assert sorted(map(tuple, got.collect())) == [("1999", "c", 3, "ü", None), ("2001", "a", 1, None, None), ("2001", "b", 2, 'x, "y"', None)]
    with pytest.raises(FileExistsError):
        tables.write_year_files(df.coalesce(1), str(tmp_path), "atp", F.col("y"))


def test_table_inventory(spark, tmp_path):
    days = spark.createDataFrame([(dt.date(2024, 1, 2), "a"), (dt.date(2024, 3, 1), "b"), (None, None)], "day date, name string")
    days.repartition(2).write.parquet(f"{tmp_path}/days")
    days.limit(0).write.parquet(f"{tmp_path}/none")
    (tmp_path / "bare").mkdir()
    asked = {"days": ("days", "day"), "names": ("days", "name"), "none": ("none", "day"), "bare": ("bare", "day"), "gone": ("gone", None)}
    got = {r.artifact: r for r in tables.table_inventory(spark, {k: (f"{tmp_path}/{p}", c) for k, (p, c) in asked.items()}).collect()}
    assert {k: tuple(r)[1:4] for k, r in got.items()} == {
        "days": (True, 3, "2024-03-01"), "names": (True, 3, "b"), "none": (True, 0, None), "bare": (False, None, None), "gone": (False, None, None)}
    files = list((tmp_path / "days").glob("*.parquet"))
    assert (got["days"].files, got["days"].bytes) == (len(files), sum(f.stat().st_size for f in files)) and got["gone"].bytes is None
    days.limit(0).write.mode("append").parquet(f"{tmp_path}/days")  # a file without rows beside the others
    again = tables.table_inventory(spark, {"days": (f"{tmp_path}/days", "day")}).first()
    assert (again.row_count, again.latest, again.files) == (3, "2024-03-01", len(files) + 1)
    plan = tables.from_footers(spark, f"{tmp_path}/days").agg(F.max("day"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(day)]" in plan
    assert tables.table_inventory(spark, {}).count() == 0


def test_json_map_and_codes(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text("﻿" + json.dumps({"Rome": "ita", "Odd": "no", "Paris": " FRA "}), encoding="utf-8")
    got = tables.country_codes(tables.scan_json_map(spark, str(path)))
    assert {tuple(r) for r in got.collect()} == {("Rome", "ITA"), ("Paris", "FRA")}


def test_snapshot_and_history(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    df = spark.createDataFrame([(1, day), (2, day)], "k int, d date")
    tables.write_snapshot(df, f"{tmp_path}/csv", form="csv")
    tables.write_snapshot(df.limit(1), f"{tmp_path}/csv", form="csv")
    text = [r[0] for r in spark.read.text(f"{tmp_path}/csv").collect()]
    assert text == ["k,d", "1,2024-03-01"]
    tables.write_snapshot(df, f"{tmp_path}/parts", ["k"])
    assert (tmp_path / "parts" / "k=1").exists()
    expected = {"k": "int", "extra": "string"}
    tables.append_history(df, f"{tmp_path}/hist", expected)
    tables.append_history(df, f"{tmp_path}/hist", expected)
    got = spark.read.parquet(f"{tmp_path}/hist")
    assert got.count() == 4 and got.columns == ["k", "extra"]


def test_payload(spark):
    df = spark.createDataFrame([(1, float("nan"), None, dt.datetime(2024, 1, 2, 3, 4, 5))], "a int, b double, c string, t timestamp")
    assert json.loads(tables.row_payload(df).first()["payload"]) == {"a": 1, "b": None, "c": None, "t": "2024-01-02T03:04:05Z"}


def test_ledger_keeps_the_newest(spark):
    doc = json.dumps({"capital": 5.0, "history": [{"timestamp": f"t{i}", "pnl": i} for i in range(7)]})
    docs = spark.createDataFrame([("l", doc), ("none", "{}")], "id string, doc string")
    assert [r["timestamp"] for r in ledger.ledger_events(docs, "id", "doc", keep=3).orderBy("pos").collect()] == ["t4", "t5", "t6"]
    assert {r["id"]: (r["capital"], r["history_count"]) for r in ledger.ledger_state(docs, "id", "doc").collect()} == {"l": (5.0, 7), "none": (0.0, 0)}


def test_page_records(spark):
    page = "\n".join([
        "1. round", "| Start | Round | S |", "| x | | [Ann Lee](/a) (3) | 2 | 6 | 7 |", "| x | | [Bo Kim](/b) | 0 | 4 | 62 |", "",
        "Final", "| x | | [Cy Ott](/c) | 1 | 3 | 6 | 2 |", "| x | | [Di Fox](/d) (11) | 2 | 6 | 4 | 6 |", "| x | | [Lone](/e) | 1 | 6 |", "text",
        "| x | QF | [Ed Poe](/e) | 2 | 6 | 6 |", "| x | | [Flo Ray](/f) | 0 | 1 | 2 |"])
    df = spark.createDataFrame([("p", page)], "id string, text string")
    got = [tuple(r)[2:] for r in pages.match_records(df, "id", "text", F.lit(32)).orderBy("line_no").collect()]
    assert got == [
        ("R32", "6-4 7-6(2)", "Ann Lee", "Bo Kim", "3", ""), ("F", "6-3 4-6 6-2", "Di Fox", "Cy Ott", "11", ""), ("QF", "6-1 6-2", "Ed Poe", "Flo Ray", "", "")]


def snapshots(n=60):
    rows = []
    for i in range(n):
        rows.append((i, i % 4, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.5 + (i * 7 % 11) / 10, 2.0 + (i * 5 % 7) / 10))
    return rows


SNAP = "snapshot_id long, match_id long, captured_at timestamp, odds_p1 double, odds_p2 double"


def feed(spark, path, batches):
    """One file per micro-batch, read one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SNAP).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    files = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    return files.withColumn("match_date", F.to_date("captured_at"))


MOVES = ["snapshot_id", "prev_captured_at", "odds_p1_delta", "odds_p2_pct", "hours_since_previous", "market_move"]


def in_order(df, names):
    return [tuple(r) for r in df.select(*names).orderBy("snapshot_id").collect()]


@pytest.mark.parametrize("options", [{}, {"compact_every": 1}, {"segment_rows": 5}])
def test_movement_stream_equals_batch(spark, tmp_path, options):
    rows = snapshots()
    stream = feed(spark, tmp_path / "in", [rows[:25], rows[25:26], rows[26:40], rows[40:]])
    streams.stream_odds_movement(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **options).trigger(availableNow=True).start().awaitTermination()
    batch = marketplace.odds_movement(spark.createDataFrame(rows, SNAP), ["match_id"], "captured_at")
    assert in_order(streams.read_movements(spark, str(tmp_path / "out")), MOVES) == in_order(batch, MOVES)


def test_movement_stream_late_rows_have_no_predecessor(spark, tmp_path):
    rows = snapshots(12)
    stream = feed(spark, tmp_path / "in", [rows[4:8], rows[:4], rows[8:]])
    streams.stream_odds_movement(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = {r["snapshot_id"]: r for r in streams.read_movements(spark, str(tmp_path / "out")).collect()}
    assert len(found) == 12 and all(found[k].market_move == "no_prior_snapshot" for k in range(8))
    # Late rows leave the state alone: the next ones follow those of the first batch.
    assert [found[k].prev_captured_at for k in range(8, 12)] == [rows[k - 4][2] for k in range(8, 12)]


def test_movement_batches_run_again_after_a_failure(spark, tmp_path):
    rows, table = snapshots(24), str(tmp_path / "t")
    parts = [spark.createDataFrame(rows[k:k + 8], SNAP) for k in (0, 8, 16)]
    key = F.col("match_id").cast("string")
    for number, part in enumerate(parts):
        for _ in range(2):
            streams.movement_batch(part, number, table, key, compact_every=2)
    streams.movement_batch(parts[2], 2, table, key, compact_every=2)
    batch = marketplace.odds_movement(spark.createDataFrame(rows, SNAP), ["match_id"], "captured_at")
    assert in_order(streams.read_movements(spark, table), MOVES) == in_order(batch, MOVES)
    assert sorted(p.name for p in (tmp_path / "t" / "last").iterdir()) == ["base-2", "batch-2"]


def test_movement_of_odd_rows(spark, tmp_path):
    """NULL times, NULL keys and equal instants, in a batch and across batches."""
    at = dt.datetime(2024, 1, 1)
    first = [(1, 7, at, 2.0, 2.0), (2, 7, at, 2.1, 2.0), (3, None, at, 2.0, 2.0), (4, 7, None, 2.0, 2.0)]
    second = [(5, 7, at, 3.0, 2.0), (6, 7, at + dt.timedelta(hours=1), 2.2, None), (7, None, at + dt.timedelta(hours=1), 2.5, 2.0)]
    for number, rows in enumerate((first, second, [])):
        streams.movement_batch(spark.createDataFrame(rows, SNAP), number, str(tmp_path / "t"), F.coalesce(F.col("match_id").cast("string"), F.lit("")))
    found = {r["snapshot_id"]: r.prev_odds_p1 for r in streams.read_movements(spark, str(tmp_path / "t")).collect()}
    assert found == {1: None, 2: 2.0, 3: None, 4: None, 5: None, 6: 2.1, 7: 2.0}


def test_a_key_that_moves_to_another_day(spark, tmp_path):
    table, day = str(tmp_path / "t"), dt.date(2024, 1, 1)
    at = dt.datetime(2023, 12, 31, 12)
    schema = SNAP + ", match_date date"

    def merge(*rows):
        streams.merge_batch(spark.createDataFrame([(s, m, at, p, 2.0, d) for s, m, p, d in rows], schema), table, ["snapshot_id"])
        return sorted((r.match_id, r.odds_p1, r.match_date.day, r.is_current) for r in streams.read_odds_table(spark, table).collect())

    later = day + dt.timedelta(days=1)
    assert merge((1, 1, 1.5, day), (2, 2, 1.6, day)) == [(1, 1.5, 1, True), (2, 1.6, 1, True)]
    assert merge((3, 1, 1.7, later)) == [(1, 1.7, 2, True), (2, 1.6, 1, False)]
    assert merge((4, 2, 1.8, later), (5, 3, 1.9, day)) == [(1, 1.7, 2, False), (2, 1.8, 2, True), (3, 1.9, 1, True)]
    # A day left without rows goes, and the locator follows a key back.
    assert merge((6, 3, 2.0, later)) == [(1, 1.7, 2, False), (2, 1.8, 2, False), (3, 2.0, 2, True)]
    assert merge((7, 3, 2.1, day)) == [(1, 1.7, 2, False), (2, 1.8, 2, False), (3, 2.1, 1, True)]


def test_a_table_without_locator_gets_one(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame(snapshots(6), SNAP).withColumn("match_date", F.to_date("captured_at"))
    rows.write.partitionBy("match_date").parquet(f"{table}/rows")
    moved = rows.filter("snapshot_id = 2").withColumn("match_date", F.date_add("match_date", 9))
    streams.merge_batch(moved, table, ["snapshot_id"])
    assert streams.read_odds_table(spark, table).filter("snapshot_id = 2").count() == 1 and streams.read_odds_table(spark, table).count() == 6


def test_upsert_stream(spark, tmp_path):
    rows = snapshots(30)
    again = [(100, rows[3][1], rows[3][2], 9.0, 9.0)]
    stream = feed(spark, tmp_path / "in", [rows[:20], rows[20:], again])
    table = str(tmp_path / "table")
    streams.stream_odds_upsert(stream, table, str(tmp_path / "cp"), ["snapshot_id"]).trigger(availableNow=True).start().awaitTermination()
    got = streams.read_odds_table(spark, table)
    # Merging is by key: the repeat replaces the snapshot it repeats, however late it comes.
    assert got.count() == 30 and got.filter("odds_p1 = 9.0").count() == 1
    assert [r["snapshot_id"] for r in got.filter("is_current").collect()] == [100]
    again = [(101, rows[3][1], rows[3][2], 9.5, 9.5)]
    streams.merge_batch(spark.createDataFrame(again, SNAP).withColumn("match_date", F.to_date("captured_at")), table, ["snapshot_id"])
    got = streams.read_odds_table(spark, table)
    assert got.count() == 30 and got.filter("odds_p1 = 9.5").count() == 1
    assert [r["snapshot_id"] for r in got.filter("is_current").collect()] == [101]


@pytest.mark.parametrize("times", [1, 2])
def test_merging_a_batch_twice_changes_nothing(spark, tmp_path, times):
    batch = spark.createDataFrame(snapshots(10), SNAP).withColumn("match_date", F.to_date("captured_at"))
    for _ in range(times):
        streams.merge_batch(batch, str(tmp_path / "t"), ["snapshot_id"])
    assert streams.read_odds_table(spark, str(tmp_path / "t")).count() == 10


def tree(spark, *lines, draw=32):
    rows = spark.createDataFrame([("p", "\n".join(lines), draw)], "page string, text string, draw int")
    return [(r["round"], r.winner_name, r.winner_seed, r.loser_name, r.loser_seed, r.score) for r in pages.tree_records(
        rows, "page", "text", F.col("draw")).orderBy("line_no").collect()]


def test_tree_pages(spark):
    won, lost = "[row] 02.03. 14:05 SF Ann B. (2) 2 6 7", "[row] Cid D. 0 3 6 5"
    assert tree(spark, won, lost) == [("SF", "Ann B.", "2", "Cid D.", "", "6-3 7-6(5)")]
    assert tree(spark, won, "text 1 2", "", lost) == [("SF", "Ann B.", "2", "Cid D.", "", "6-3 7-6(5)")]
    assert tree(spark, won, "[row]", "[cell] Cid D.", "[cell] 0", "x", "[cell] 3", "[cell] 6") == [("SF", "Ann B.", "2", "Cid D.", "", "6-3 7-6")]
    # The loser's left-over numbers come before the winner's.
    assert tree(spark, "[row] 02.03. 14:05 F A 2 7 7 9", "[row] B 0 6 6 4")[0][-1] == "7-6(4) 7-6(9)"
    assert tree(spark, "[row] 02.03. 14:05 F A 2 6 6 1.50 2.60", "[row] B 0 1 2 info 7")[0][-1] == "6-1 6-2"


def test_tree_pages_without_a_record(spark):
    won = "[row] 02.03. 14:05 SF Ann B. 2 6 7"
    assert tree(spark, won) == []
    assert tree(spark, won, won) == []
    assert tree(spark, won, "[row] Cid 9 9") == []  # no count of sets
    assert tree(spark, won, "[row] 0 3 6") == [("SF", "Ann B.", "", "0", "", "6-6")]  # the first token is always the name's
    assert tree(spark, won, "[row] Cid 0") == []  # no games
    assert tree(spark, "[row] 2.3. 14:05 SF Ann 2 6 6", "[row] Cid 0 1 1") == []
    assert tree(spark, "[row]", "[row]  ") == []
    assert tree(spark, won, "[row] Cid 0 12345678901234567890 6") == [("SF", "Ann B.", "", "Cid", "", "7-6")]  # no such number


def test_pages_of_both_forms_and_nulls(spark):
    rows = spark.createDataFrame([("a", "| [X](/p) | 2 | 6 | 6 |\n| [Y](/p) | 0 | 1 | 2 |", 32), ("b", None, 32), ("c", "", None)], "page string, text string, draw int")
    assert [(r.page, r.score) for r in pages.page_records(rows, "page", "text", F.col("draw")).collect()] == [("a", "6-1 6-2")]


def test_pages_are_read_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", "x\n| [A](/p) | 2 | 6 | 6 |\n| [B](/p) | 0 | 1 | 2 |"), ("a", "[row]\n[cell] 1")], "page string, text string").repartition(2)
    plan = pages.page_records(rows, "page", "text", F.lit(32))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_pages_of_both_forms_are_read_once(spark):
    """One walk in plain code; array expressions took a scan of the pages for each form and evaluated every line several times."""
    rows = spark.createDataFrame([
        ("a", "1. round\n| [A](/p) | 2 | 6 | 6 |\r\n| [B](/p) (4) | 0 | 1 | 2 |\r\n", None), ("b", "x\r\n[row] 02.03. 14:05 2R A (1) 2 6 7 5\r\n[row] B 0 3 6", 64), (None, "[row]", 8)],
        "page string, text string, draw int")
    out = pages.page_records(rows, "page", "text", F.col("draw"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "lambda" not in plan and plan.count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect())) == [
        ("a", 1, "R128", "6-1 6-2", "A", "B", "", "4"), ("b", 1, "R32", "6-3 7-6(5)", "A", "B", "1", "")]
