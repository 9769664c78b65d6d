"""Names from outside to known entities: override, exact, last name with initial, near spelling, words in any order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.functions.text import normalize_name
from boutwise.operators.keyed import small
from boutwise.session import materialize

LEAST_THRESHOLD = 60.0  # below, a short name may change all its letters
EPS = 1e-9
LAST_INITIAL = r"^(.+?)\s+([A-Za-z])\.?$"
INITIAL_LAST = r"^([A-Za-z])\.?\s+(.+)$"
ORDER_SHARE = 0.95  # what a likeness counts that takes no notice of the order of words
PAIRED_EDITS = 4  # a known name that may have no more edits is looked for by two unchanged parts, a longer one by one
PAIRED_LENGTH = 64  # and this length at most, so that the places listed are bounded
TASK_TEXTS = 20_000  # texts whose keys a task lists
LEAST_COMMON = 2  # words that two names must share before further words of either are passed over


def similarity(a: Column, b: Column) -> Column:
    """Share of letters that need no edit, in percent."""
    return 100.0 * (1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def _most_edits(length: Column, share: float) -> Column:
    """Edits between a name of this length and any name it may still be similar to."""
    return F.floor((F.floor(length / share + EPS)) * (1.0 - share) + EPS).cast("int")


def _part(length: Column, i: Column, share: float) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of the even parts that a name of this length is cut into."""
    parts = _most_edits(length, share) + 1
    size, larger = F.floor(length / parts), length % parts  # the last `larger` parts hold one letter more
    return i * size + F.greatest(F.lit(0), i - (parts - larger)), size + (i >= parts - larger).cast("int")


def _up_to(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _own_parts(name: Column, share: float) -> Column:
    """Keys of a known name: each of its parts, with its length and the part's number.

    A name cut into one part more than it may have edits keeps one part unchanged in every similar name, so an equi-join on
    parts meets all of them without comparing every pair.
    """
    length = F.length(name)

    def key(i: Column) -> Column:
        start, size = _part(length, i, share)
        return F.concat_ws("|", length.cast("string"), i.cast("string"), F.substring(name, start + 1, size))

    return F.transform(_up_to(F.lit(0), _most_edits(length, share)), key)


def _possible_parts(name: Column, share: float, beyond: int = -1) -> Column:
    """Keys of an open name: all parts that similar names of any length above `beyond` might share with it."""
    own = F.length(name)

    def of_length(length: Column) -> Column:
        most = _most_edits(length, share)

        def of_part(i: Column) -> Column:
            start, size = _part(length, i, share)
            # Edits before the part shift it, edits after it make up the rest of the difference in length.
            places = F.filter(_up_to(F.greatest(F.lit(0), start - most), F.least(own - size, start + most)),
                              lambda at: F.abs(at - start) + F.abs(own - length - (at - start)) <= most)
            return F.transform(places, lambda at: F.concat_ws(
                "|", length.cast("string"), i.cast("string"), F.substring(name, at + 1, size)))

        return F.flatten(F.transform(_up_to(F.lit(0), most), of_part))

    lengths = _up_to(F.greatest(F.ceil(own * share - EPS), F.lit(beyond + 1)), F.floor(own / share + EPS))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def _allowed(longest: int, share: float) -> int:
    """Edits between two similar names of which the longer has this length."""
    return math.floor(longest * (1.0 - share) + EPS)


def _longest_paired(share: float) -> int:
    """The largest length of a known name that is looked for by two parts."""
    length = 0
    while length < PAIRED_LENGTH and _allowed(math.floor((length + 1) / share + EPS), share) <= PAIRED_EDITS:
        length += 1
    return length


def _even_parts(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of the even parts that a name is cut into."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def part_pairs(own: int, known: int, share: float) -> list[tuple[int, ...]]:
    """Which two parts of a known name of this length a similar name of the length `own` may hold, and where.

    Rows of own, known, i, j, start and length of both parts in the known name, and both starts in the other name. A known name is
    cut into two parts more than it may have edits, so at least two stay unchanged. Where these two lengths allow fewer edits,
    more parts stay: then the parts are put into groups, one fewer than parts stay, and two of them share a group.
    """
    count = _allowed(math.floor(known / share + EPS), share) + 2
    edits, parts = _allowed(max(own, known), share), _even_parts(known, count)
    groups, more = count - edits - 1, own - known
    found = []
    for i in range(count):
        for j in range(i + 1, count):
            if (j - i) % groups:
                continue
            (a, m), (b, n) = parts[i], parts[j]
            # Edits before a part shift it; those between both parts and behind the second make up the other differences.
            found += [
                (own, known, i, j, a, m, b, n, a + s, b + t) for s in range(-edits, edits + 1) for t in range(-edits, edits + 1)
                if abs(s) + abs(t - s) + abs(more - t) <= edits and a + s >= 0 and b + t >= a + s + m and b + t + n <= own]
    return found


def similar_texts(open_texts: DataFrame, known_texts: DataFrame, share: float) -> DataFrame:
    """Pairs (`_a`, `_b`) of an open and a known text whose similarity reaches the share, each once or more.

    Both tables have one column of different texts. Candidates come from equi-joins. A known text with few edits shares two of its parts
    with every similar text, which few other texts do; the places of such parts depend on both lengths alone, so they are listed
    once for the lengths there are. A longer text has too many places for two parts and is looked for by one.
    """
    spark, limit = open_texts.sparkSession, _longest_paired(share)
    mine, theirs = open_texts.toDF("_a"), known_texts.toDF("_b")
    mine = mine.repartition(max(1, -(-mine.count() // TASK_TEXTS))).withColumn("own", F.length("_a"))
    theirs = theirs.repartition(max(1, -(-theirs.count() // TASK_TEXTS))).withColumn("known", F.length("_b"))
    held = [r[0] for r in theirs.select(F.least("known", F.lit(limit + 1))).distinct().collect()]  # limit + 2 rows at most
    patterns = [p for known in held if known <= limit
                for own in range(math.ceil(known * share - EPS), math.floor(known / share + EPS) + 1) for p in part_pairs(own, known, share)]
    places = spark.createDataFrame(patterns, "own int, known int, i int, j int, a int, m int, b int, n int, _c int, _d int")
    cuts = places.select("known", "i", "j", "a", "m", "b", "n").distinct()

    def key(text: str, first: str, second: str) -> Column:
        return F.xxhash64("known", "i", "j", F.expr(f"substring({text}, {first} + 1, m)"), F.expr(f"substring({text}, {second} + 1, n)")).alias("_v")

    met = mine.join(F.broadcast(places), "own").select("_a", key("_a", "_c", "_d")).join(
        theirs.join(F.broadcast(cuts), "known").select("_b", key("_b", "a", "b")), "_v").select("_a", "_b")
    if limit + 1 in held:
        long = mine.filter(F.floor(F.col("own") / share + EPS) > limit).select("_a", F.explode(_possible_parts(F.col("_a"), share, limit)).alias("_v"))
        met = met.unionByName(long.join(
            theirs.filter(F.col("known") > limit).select("_b", F.explode(_own_parts(F.col("_b"), share)).alias("_v")), "_v").select("_a", "_b"))
    # With a bound on the edits, unlike texts are told apart early.
    return met.filter(F.expr(f"levenshtein(_a, _b, CAST(floor(greatest(length(_a), length(_b)) * {1.0 - share!r}D + {EPS!r}D) AS INT)) >= 0"))


def _words(norm: Column) -> Column:
    """Words of a normalised name, sorted; a comma ends a word."""
    return F.array_sort(F.split(F.trim(F.regexp_replace(norm, r"[,\s]+", " ")), " "))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def any_order_score(a: Column, b: Column) -> Column:
    """Likeness of two normalised names, the order of their words left out, in percent and at most 95.

    The larger of two: the similarity of both names with their words sorted; and, for names with at least two different words in
    common, the best similarity among the common words alone and the common words followed by what only one name has.
    A name whose words are all in the other one is as like as can be.
    """
    mine, theirs = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    common = F.array_intersect(mine, theirs)
    both = _joined(common)
    first, second = (_joined(F.concat(common, F.array_except(x, common))) for x in (mine, theirs))
    shared = F.when(F.size(common) >= LEAST_COMMON, F.greatest(similarity(both, first), similarity(both, second), similarity(first, second)))
    return ORDER_SHARE * F.greatest(similarity(_joined(_words(a)), _joined(_words(b))), F.coalesce(shared, F.lit(0.0)))


def _word_pairs(norm: Column) -> Column:
    """Keys of a name: every two of its different words."""
    words = F.array_distinct(_words(norm))

    def with_later(word: Column, i: Column) -> Column:
        return F.transform(F.slice(words, i + 2, F.size(words)), lambda other: F.concat_ws(" ", word, other))

    return F.flatten(F.transform(words, with_later))


def names_in_any_order(open_names: DataFrame, name: str, by_name: DataFrame, threshold: float) -> DataFrame:
    """Per open name that some known name is like in other order: `_b`, the best one (`_hit`, `_s`); a tie goes to the least entity id.

    Two names at or above the threshold have nearly the same sorted text, and then a part of it, or they have two words in common.
    Candidates come from equi-joins on those parts and on pairs of words, so none is missed and not all names are compared.
    """
    share = threshold / 100.0 / ORDER_SHARE
    if not LEAST_THRESHOLD / 100.0 <= share <= 1.0:
        raise ValueError(f"a threshold from {LEAST_THRESHOLD * ORDER_SHARE:g} to {ORDER_SHARE * 100:g} can be met in any order")
    sorted_text = _joined(_words(F.col("norm")))
    mine = materialize(open_names.select(name, "norm", sorted_text.alias("_a"), _word_pairs(F.col("norm")).alias("_w")))
    theirs = materialize(by_name.select(F.col("norm").alias("_norm"), "_hit", sorted_text.alias("_b"), _word_pairs(F.col("norm")).alias("_w")))
    like = similar_texts(mine.select("_a").distinct(), theirs.select("_b").distinct(), share).distinct()
    by_text = mine.drop("_w").join(like, "_a").join(theirs.drop("_w"), "_b").drop("_a", "_b")
    by_words = mine.select(name, "norm", F.explode("_w").alias("_v")).join(theirs.select("_norm", "_hit", F.explode("_w").alias("_v")), "_v").drop("_v")
    scored = by_text.unionByName(by_words).withColumn("_s", any_order_score(F.col("norm"), F.col("_norm"))).filter(F.col("_s") >= threshold - EPS)
    return scored.groupBy(name).agg(F.max_by(F.struct("_hit", "_s"), F.struct("_s", -F.col("_hit.entity_id"))).alias("_b"))


def resolve_names(
    raw: DataFrame, name: str, pool: DataFrame, overrides: DataFrame | None = None, threshold: float = 85.0, any_order: bool = False,
) -> DataFrame:
    """Each distinct raw name with the entity it means: `entity_name`, `entity_id`, `score`, `stage`.

    `pool` has `entity_id`, `first_name`, `last_name`. A stage sees only names the earlier ones left
    open. Names with the same last name and initial carry no more than these two, so the pool is
    reduced to one candidate per block before it is joined. The score is an edit-distance share, not
    the scorer of any fuzzy-matching package, so thresholds are this library's own. Near names are all those at or
    above the threshold, however many edits that allows. With `any_order`, names still open are compared once more with
    their words in any order and words of one name left out (`any_order_score`).
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"a threshold of {LEAST_THRESHOLD} at least keeps part of every name")
    share = threshold / 100.0
    full = F.concat_ws(" ", "first_name", "last_name")
    pool = pool.withColumn("full", full).withColumn("norm", normalize_name(full))
    by_name = materialize(pool.groupBy("norm").agg(F.min_by(F.struct("full", "entity_id"), "entity_id").alias("_hit")))
    names = raw.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("norm", normalize_name(F.col(name)))

    def answer(df: DataFrame, entity_name: Column, entity_id: Column, score: Column, stage: str) -> DataFrame:
        return df.select(
            name, entity_name.alias("entity_name"), entity_id.alias("entity_id"),
            score.cast("double").alias("score"), F.lit(stage).alias("stage"))

    answers, open_names = [], names
    if overrides is not None:
        table = small(overrides.groupBy(normalize_name(F.col("raw")).alias("norm")).agg(F.max("canonical").alias("_to")))
        hit = open_names.join(table, "norm").withColumn("_n", normalize_name(F.col("_to")))
        hit = hit.join(by_name.withColumnRenamed("norm", "_n"), "_n", "left")
        answers.append(answer(hit, F.col("_to"), F.col("_hit.entity_id"), F.lit(100.0), "override"))
        open_names = open_names.join(table, "norm", "left_anti")
    exact = materialize(open_names.join(by_name, "norm", "left"))  # stored, so that no stage runs the earlier ones again
    answers.append(answer(
        exact.filter("_hit IS NOT NULL"), F.col("_hit.full"), F.col("_hit.entity_id"), F.lit(100.0), "exact"))
    open_names = exact.filter("_hit IS NULL").drop("_hit")

    text = F.trim(F.col(name))
    by_last, by_first = text.rlike(LAST_INITIAL), text.rlike(INITIAL_LAST)
    last = F.when(by_last, F.regexp_extract(text, LAST_INITIAL, 1)).when(by_first, F.regexp_extract(text, INITIAL_LAST, 2))
    initial = F.when(by_last, F.regexp_extract(text, LAST_INITIAL, 2)).when(by_first, F.regexp_extract(text, INITIAL_LAST, 1))
    blocks = pool.groupBy(
        normalize_name(F.col("last_name")).alias("_last"),
        F.substring(normalize_name(F.col("first_name")), 1, 1).alias("_initial"),
    ).agg(F.count("*").alias("_c"),
          F.min(F.struct(F.length("full").alias("l"), "entity_id", "full")).alias("_hit"))
    blocked = materialize(open_names.withColumns({"_last": normalize_name(last), "_initial": F.lower(initial)}).join(
        blocks, ["_last", "_initial"], "left"))
    answers.append(answer(
        blocked.filter("_hit IS NOT NULL"), F.col("_hit.full"), F.col("_hit.entity_id"),
        F.when(F.col("_c") == 1, F.lit(100.0)).otherwise(similarity(F.col("norm"), normalize_name(F.col("_hit.full")))),
        "block"))
    open_names = blocked.filter("_hit IS NULL").select(name, "norm")

    like = similar_texts(open_names.select("norm").distinct(), by_name.select("norm"), share).distinct()
    near = open_names.join(like, F.col("norm") == F.col("_a")).join(by_name.select(F.col("norm").alias("_b"), "_hit"), "_b").withColumn(
        "_s", similarity(F.col("norm"), F.col("_b"))).filter(F.col("_s") >= threshold)
    best = near.groupBy(name).agg(F.max_by(F.struct("_hit", "_s"), F.struct("_s", -F.col("_hit.entity_id"))).alias("_b"))
    found = materialize(open_names.join(best, name, "left"))
    answers.append(answer(
        found.filter("_b IS NOT NULL"), F.col("_b._hit.full"), F.col("_b._hit.entity_id"), F.col("_b._s"), "near"))
    if any_order:
        still = found.filter("_b IS NULL").drop("_b")
        found = materialize(still.join(names_in_any_order(still, name, by_name, threshold), name, "left"))
        answers.append(answer(
            found.filter("_b IS NOT NULL"), F.col("_b._hit.full"), F.col("_b._hit.entity_id"), F.col("_b._s"), "any order"))
    answers.append(answer(
        found.filter("_b IS NULL"), F.col(name), F.lit(None).cast(pool.schema["entity_id"].dataType), F.lit(0.0), "open"))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out
