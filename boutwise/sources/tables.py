"""Scans and sinks of contest tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutwise.functions.text import blank_to_null, canonical_id, normalize_name
from boutwise.session import delete_folder, folder_names, rename

# The 49 columns of a raw result file, and the 15 of a hand-kept one.
_SIDE = ["id", "seed", "entry", "name", "hand", "ht", "ioc", "age"]
_STATS = ["ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced"]
RAW_COLUMNS = [
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date", "match_num",
    *[f"winner_{c}" for c in _SIDE], *[f"loser_{c}" for c in _SIDE], "score", "best_of", "round", "minutes",
    *[f"w_{c}" for c in _STATS], *[f"l_{c}" for c in _STATS],
    "winner_rank", "winner_rank_points", "loser_rank", "loser_rank_points",
]
CUSTOM_COLUMNS = [
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date", "match_num",
    "winner_id", "winner_name", "loser_id", "loser_name", "score", "best_of", "round", "source",
]
_NUMBERS = {
    "draw_size", "match_num", "best_of", "minutes", "winner_rank", "winner_rank_points", "loser_rank",
    "loser_rank_points", *[f"{s}_{c}" for s in "wl" for c in _STATS],
}
_REALS = {"winner_ht", "loser_ht", "winner_age", "loser_age"}


def raw_schema() -> T.StructType:
    def kind(name: str) -> T.DataType:
        return T.IntegerType() if name in _NUMBERS else T.DoubleType() if name in _REALS else T.StringType()

    return T.StructType([T.StructField(c, kind(c)) for c in RAW_COLUMNS])


def scan_year_files(spark: SparkSession, path: str, tour: str, source: str = "files") -> DataFrame:
    """All `{tour}_matches_<digits>.csv` of a folder, each row with the file it came from."""
    rows = (
        spark.read.schema(raw_schema()).option("header", True).option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", True).option("pathGlobFilter", f"{tour}_matches_*.csv").csv(path)
    )
    return rows.select(
        *RAW_COLUMNS, F.lit(source).alias("source"), F.col("_metadata.file_name").alias("source_file"),
    ).filter(F.col("source_file").rlike(rf"^{tour}_matches_\d+\.csv$"))


def write_year_files(df: DataFrame, path: str, tour: str, year: Column) -> None:
    """Raw results as `{tour}_matches_<year><file number>.csv`, the form `scan_year_files` reads; rows without a year are left out.

    Spark writes the rows by year; only the files are renamed afterwards. Files of the same name are an error.
    """
    spark, work = df.sparkSession, f"{path}/_by_year-{uuid.uuid4().hex}"
    expected = {f.name: f.dataType.simpleString() for f in raw_schema()}
    rows = align(df.withColumn("_year", year), {**expected, "_year": "string"}).filter("_year IS NOT NULL")
    rows.write.partitionBy("_year").option("header", True).csv(work)
    for part in folder_names(spark, work):
        if part.startswith("_year="):
            files = sorted(f for f in folder_names(spark, f"{work}/{part}") if f.endswith(".csv"))
            for number, file in enumerate(files):
                rename(spark, f"{work}/{part}/{file}", f"{path}/{tour}_matches_{part.removeprefix('_year=')}{number:05d}.csv")
    delete_folder(spark, work)


def table_inventory(spark: SparkSession, tables: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row per named table of parquet files (`path`, day column or None): artifact, present, row_count, latest, files, bytes, last_modified.

    Row counts read no column, and latest days come from the parquet footers where the type has statistics that hold (dates and
    numbers), else from a scan of that one column; sizes and times come from the file listing, which Spark spreads over its tasks. A missing or empty
    folder has present false and NULL figures; a file that is no parquet is an error.
    """
    shape = "artifact string, present boolean, row_count bigint, latest string, files bigint, bytes bigint, last_modified timestamp"
    out = spark.createDataFrame([(name, False, *[None] * 5) for name, (path, _) in tables.items() if not folder_holds(spark, path)], shape)
    for name, (path, day) in tables.items():
        if not folder_holds(spark, path):
            continue
        # Not counted from footers: Spark's count is then NULL where all files are without rows.
        counted = spark.read.parquet(path).agg(F.count("*").alias("row_count"))
        figures = counted.crossJoin(from_footers(spark, path).agg(F.max(day).cast("string").alias("latest"))) if day else counted.withColumn("latest", F.lit(None).cast("string"))
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("last_modified"))
        # All sides are single rows.
        out = out.unionByName(figures.crossJoin(listed).select(F.lit(name).alias("artifact"), F.lit(True).alias("present"), *figures.columns, *listed.columns))
    return out


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose ungrouped least and greatest values Spark answers from file footers."""
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return spark.read.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def folder_holds(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, or a folder with anything but hidden names in it."""
    return any(not n.startswith(("_", ".")) for n in folder_names(spark, path))


def align(df: DataFrame, expected: dict[str, str], **fixed: str) -> DataFrame:
    """Exactly the expected columns in order: missing ones are NULL, fixed ones are overwritten."""
    return df.select(*[
        F.lit(fixed[name]).alias(name) if name in fixed
        else F.col(name).cast(kind).alias(name) if name in df.columns
        else F.lit(None).cast(kind).alias(name)
        for name, kind in expected.items()
    ])


def scan_players(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per player id, the first in `order`, with full and normalised name and country."""
    full = F.concat_ws(" ", blank_to_null(F.col("name_first")), blank_to_null(F.col("name_last")))
    named = df.withColumns({
        "player_id": canonical_id(F.col("player_id")), "canonical_name": full,
        "ioc": F.upper(blank_to_null(F.col("ioc"))),
    }).filter(F.col("player_id").isNotNull() & (F.col("canonical_name") != ""))
    first = named.groupBy("player_id").agg(
        F.min_by(F.struct("canonical_name", "ioc"), F.struct(*order)).alias("p"))
    return first.select(
        "player_id", "p.canonical_name", normalize_name(F.col("p.canonical_name")).alias("normalized_name"), "p.ioc")


def scan_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file as (key, value) rows; a byte order mark in front is tolerated."""
    text = spark.read.text(path, wholetext=True)
    return explode_json_map(text, F.col("value")).select("key", "value")


def explode_json_map(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    clean = F.regexp_replace(text, "^﻿", "")
    pairs = F.from_json(clean, T.MapType(T.StringType(), T.StringType()))
    return df.select(*keep, F.explode(pairs).alias("key", "value"))


def country_codes(pairs: DataFrame) -> DataFrame:
    """Keep the pairs whose value is a three-letter code, in upper case."""
    code = F.trim("value")
    return pairs.filter(F.length(code) == 3).select("key", F.upper(code).alias("value"))


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """Replace a whole table. CSV output has a header and ISO dates."""
    writer = df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def append_history(df: DataFrame, path: str, expected: dict[str, str]) -> None:
    """Add a snapshot to an archive with the archive's columns."""
    align(df, expected).write.mode("append").parquet(path)


def scan_matches(
    df: DataFrame, tour: str, columns: list[str], eligible_only: bool = False,
    aliases: dict[str, str] | None = None, payload: str | None = None,
) -> DataFrame:
    """Some columns of one tour. A column the table lacks comes out of the JSON payload.

    Row order is left to the reader that needs one: a stored order costs a full sort.
    """
    aliases = aliases or {}

    def pick(name: str) -> Column:
        if name in aliases:
            return F.col(aliases[name]).alias(name)
        if name in df.columns:
            return F.col(name)
        if payload:
            return F.get_json_object(payload, f"$.{name}").alias(name)
        return F.lit(None).cast("string").alias(name)

    rows = df.filter(F.lower("tour") == tour.lower())
    if eligible_only:
        rows = rows.filter("is_training_eligible")
    return rows.select(*[pick(c) for c in columns])


def scan_odds(df: DataFrame, current_only: bool) -> DataFrame:
    return df.filter("is_current") if current_only else df


def scan_bet_log(df: DataFrame) -> DataFrame:
    """The log in order of creation; entries without a time come first."""
    return df.orderBy(F.coalesce("created_at", F.lit("")), "prediction_id")


def row_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """The whole row as JSON text: ISO times, NULL for missing and NaN."""

    def clean(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(field.name)
        return c

    return df.withColumn(name, F.to_json(F.struct(*[clean(f) for f in df.schema]), {"ignoreNullFields": "false"}))


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str, start: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) + (start - 1))
