"""Keyed de-duplication, change detection, look-ups and entity remaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.functions.text import WIDE_PUNCTUATION, as_double, normalize_name

# Text that stands for a flag when two tables are compared.
FLAG_TEXT = {"true": "1", "false": "0", "yes": "1", "no": "0"}

# A side is sent to all executors only when a count shows it is no larger than this.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a look-up side for broadcast when a count proves it small; else the join shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, keys: list[str], rows: int, task_rows: int) -> DataFrame:
    """Keys dealt over so many tasks that the sorts of one hold a bounded number of rows as the table grows."""
    if rows <= task_rows:
        return df
    return df.repartition(max(-(-rows // task_rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Generated columns: worked out once a row, and not again in every filter and column that uses them."""
    names = ["*", *[F.col(f"_once.{name}").alias(name) for name in columns]]
    return df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))).select(*names).drop("_once")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], exempt_empty: bool = False) -> DataFrame:
    """The last row per key in `order`. Spark trims each key to one row before the shuffle.

    With `exempt_empty`, rows whose key is missing or empty are all kept.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    if not exempt_empty:
        return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    return latest_per_key(df.filter(~empty), keys, order).unionByName(df.filter(empty))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return out.withColumnRenamed("_n", rank) if rank else out.drop("_n")


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows of the whole table: a top-n, no full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def _comparable(c: Column, kind: str) -> Column:
    if kind == "text":
        return F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if kind == "int":
        return F.coalesce(F.rint(as_double(c)).cast("bigint").cast("string"), F.lit(""))
    text = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    pairs = [F.lit(x) for item in FLAG_TEXT.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[text], F.rint(as_double(c)).cast("bigint").cast("string"), F.lit(""))


def changed_rows(old: DataFrame, new: DataFrame, key: str, compare: dict[str, str]) -> DataFrame:
    """Rows of `new` that `old` lacks or holds with another value in a compared column.

    `compare` maps a column to text, int or flag. Both tables have one row per key.
    """
    before = old.select(
        F.col(key).alias("_key"), *[_comparable(F.col(c), kind).alias(f"_{c}") for c, kind in compare.items()])
    joined = new.join(before, F.col(key) == F.col("_key"), "left")
    differs = reduce(lambda a, b: a | b, [_comparable(F.col(c), k) != F.col(f"_{c}") for c, k in compare.items()])
    return joined.filter(F.col("_key").isNull() | differs).select(*new.columns)


def new_only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys), keys, "left_anti")


def lookup_two_level(df: DataFrame, name: str, pairs: DataFrame, value: str) -> DataFrame:
    """Value by exact name, else by normalised name; of several values of one name the largest."""
    exact = small(pairs.groupBy(F.col("key").alias("_k")).agg(F.max("value").alias("_exact")))
    loose = small(
        pairs.groupBy(normalize_name(F.col("key"), WIDE_PUNCTUATION).alias("_nk")).agg(F.max("value").alias("_loose")))
    return (
        df.join(exact, F.col(name) == F.col("_k"), "left")
        .join(loose, normalize_name(F.col(name), WIDE_PUNCTUATION) == F.col("_nk"), "left")
        .withColumn(value, F.coalesce("_exact", "_loose")).drop("_k", "_exact", "_nk", "_loose")
    )


def canonical_name(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """The canonical form of a name if an alias is known, else the normalised name."""
    table = aliases.groupBy(normalize_name(F.col("alias")).alias("_alias")).agg(
        F.max(normalize_name(F.col("canonical"))).alias("_canonical"))
    return (
        df.withColumn(out, normalize_name(F.col(name))).join(small(table), F.col(out) == F.col("_alias"), "left")
        .withColumn(out, F.coalesce("_canonical", out)).drop("_alias", "_canonical")
    )


def refresh_targets(targets: DataFrame, existing: DataFrame, key: str, day: str, today: Column, recent_days: int = 21):
    """Targets to fetch again: unknown ones, undated ones and recent ones, but never future ones."""
    known = existing.select(F.col(key).alias("_k")).distinct()
    joined = targets.join(known, F.col(key) == F.col("_k"), "left")
    wanted = F.col("_k").isNull() | F.col(day).isNull() | (F.col(day) >= F.date_sub(today, recent_days))
    future = F.coalesce(F.col(day) > today, F.lit(False))
    return joined.filter(~future & wanted).drop("_k")


def enrich_sides(df: DataFrame, dim: DataFrame, dim_key: str, attributes: list[str], sides: dict[str, str]) -> DataFrame:
    """Attach dimension attributes to each side; `sides` maps a prefix to the side's id column.

    Of several rows with one key the one with the largest attributes, in their order, counts.
    """
    whole = F.max(F.struct(*attributes)).alias("_a")
    dim = small(dim.groupBy(dim_key).agg(whole).select(dim_key, "_a.*"))
    for prefix, key in sides.items():
        side = dim.select(F.col(dim_key).alias("_k"), *[F.col(a).alias(f"{prefix}_{a}") for a in attributes])
        df = df.join(side, F.col(key) == F.col("_k"), "left").drop("_k")
    return df


def unknown_ids(df: DataFrame, ids: list[str], dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct ids used in any of the columns that the dimension lacks."""
    used = df.select(F.explode(F.array(*ids)).alias("id")).filter(F.col("id").isNotNull()).distinct()
    return used.join(dim.select(F.col(dim_key).alias("id")), "id", "left_anti")


def remap_ids(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Translate id columns through `mapping(old_id, new_id)`; rows with an unmapped id are dropped.

    Of several new ids of one old id the largest counts.
    """
    mapping = small(mapping.groupBy("old_id").agg(F.max("new_id").alias("new_id")))
    for c in columns:
        m = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
        df = df.join(m, F.col(c) == F.col("_old")).withColumn(c, F.col("_new")).drop("_old", "_new")
    return df


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows in the first table's columns and types; what it lacks is left out."""
    out = first
    for df in others:
        shared = [F.col(c).cast(t).alias(c) for c, t in first.dtypes if c in df.columns]
        out = out.unionByName(df.select(*shared), allowMissingColumns=True)
    return out.select(*first.columns)


def drop_invalid_pairs(df: DataFrame, a_id: str, b_id: str, names: list[str]) -> DataFrame:
    """Drop missing ids, self-opponents and doubles, which name two players with a slash."""
    keep = F.col(a_id).isNotNull() & F.col(b_id).isNotNull() & (F.col(a_id) != F.col(b_id))
    for n in names:
        keep = keep & ~F.coalesce(F.col(n).contains("/"), F.lit(False))
    return df.filter(keep)


def eligible_or_all(df: DataFrame, flag: str) -> DataFrame:
    """Only eligible rows, but all rows when none is marked eligible."""
    some = df.agg(F.coalesce(F.bool_or(flag), F.lit(False))).scalar()
    return df.filter(F.col(flag) | ~some)


def date_window(df: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    """Rows between two dates, both included."""
    if start:
        df = df.filter(F.col(day) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(day) <= F.lit(end).cast("date"))
    return df


def refuse_in_sample(df: DataFrame, day: str, cutoff: str) -> None:
    """Raise when the rows to be tested start before the model's training cutoff."""
    first = df.agg(F.min(day)).first()[0]
    if first is not None and str(first) < cutoff:
        raise ValueError(f"the window starts {first}, before the training cutoff {cutoff}")
