"""Line dedup in DataFrame operations only: explode, hash, count documents per hash, drop, reassemble by position.

Lines never leave their document: what is shuffled is 64-bit hashes of long lines, the hashes of lines that reach the
threshold, and the positions to drop. A first count by one hash finds the candidates (a collision can only add some); two
hashes, 128 bits, then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import BLANKS, ascii_lower, stored

LEAST_CHARS, LEAST_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z in lower case."""
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def _hashes(text: Column, least_chars: int) -> Column:
    """(position, h, g) of each line long enough; h and g are two hashes of its key."""
    keys = F.transform(F.split(text, "\n", -1), lambda line, at: F.struct(at.alias("at"), line_key(line).alias("key")))
    long_enough = F.filter(keys, lambda x: F.char_length(x["key"]) >= least_chars)
    return F.transform(long_enough, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g")))


def dropped_positions(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_hash, drops: the sorted positions of the lines each document loses."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).filter(F.char_length("text") >= least_chars)
    each = base.select(F.array_distinct(F.transform(_hashes(F.col("text"), least_chars), lambda x: x["h"])).alias("hs"))
    often = each.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_docs).select("h")
    often = stored(often)  # so that joins have plain shuffles on both sides, and those of hot lines can be split
    found = base.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_hashes(F.col("text"), least_chars)).alias("x")).select(
        "doc_id", "text_hash", "x.at", "x.h", "x.g").join(often, "h")
    # Dealt out by document as well, so that a line of very many documents is first counted in many tasks.
    counted = found.repartition("h", "g", "doc_id").groupBy("h", "g").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    lost = found.join(stored(counted.filter(F.col("docs") >= least_docs)), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("drops"))


def without(lines: Column, drops: Column) -> Column:
    """`lines` without the positions in the sorted array `drops`: the runs between them, in one pass."""
    marks = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(1), F.size(marks) - 1), lambda k: F.slice(
        lines, F.get(marks, k - 1) + 2, F.get(marks, k) - F.get(marks, k - 1) - 1))
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default: doc_id) plus n_lines, n_dropped and kept for every row of `docs`.

    Keys of at least `least_chars` code points that at least `least_docs` documents hold lose all their lines except in
    the largest doc_id. NULL and empty texts are one empty line. Rows that share a doc_id count as one document; a line
    that rows without doc_id hold counts for none of them, and they lose it once it is over the threshold.
    """
    keep = ["doc_id"] if keep is None else keep
    drops = dropped_positions(docs, least_chars, least_docs).select(F.col("doc_id").alias("d2"), F.col("text_hash").alias("t2"), "drops")
    rows = docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("t2")), "left")
    whole = F.coalesce("text", F.lit(""))
    lines = F.split(whole, "\n", -1)
    n_lines = F.size(lines).cast("long")
    kept = F.when(F.col("drops").isNull(), whole).otherwise(F.array_join(without(lines, F.col("drops")), "\n"))
    return rows.select(*keep, n_lines.alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
