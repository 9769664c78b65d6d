"""Mixing sources to target weights by the cube method.

A source's target over its size is the number of copies each of its documents should get on average. The whole part is
given out; the fraction is an inclusion probability, the same for a whole source. The flight phase moves the
probabilities of three documents at a time along the one direction that leaves both the expected words and the expected
documents as they are (the null space of two balancing rows), until one of the three is settled. Blocks of a source fly
in parallel, each leaving two open documents at most; the open ones of many blocks meet in the next round, until a
source has one block. Its last two open documents are the landing problem: the draw that keeps both probabilities
and has the least expected error in words.

Random choices are hashes of doc_id, size and the running number of a row among its repeats, so reruns agree whatever the
partitioning, and repeats are spread over all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutwise.llm.common import stored, word_count

BLOCK = 4_096
RUN = 4_096  # numbers of repeats that are made at once
CEILING = 3.0
EDGE = 1e-9


def source_targets(sizes: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target, rate out of one row per source (source, source_size).

    Sources in code point order (NULL last) weigh 1, 2, 3, 1, ...; a target is min(ceiling x size, weight x level) with the
    level at which all targets add up to all sizes: what resharing the excess by weight ends in. One row per source.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    cap = F.col("source_size") * F.lit(ceiling)
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("fills_at", cap / F.col("weight")).withColumns({
        "capped": F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy())})
    # Filling sources in the order in which they are full, the level is right at the first that isn't full at it.
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    rows = rows.withColumn("level", F.max(F.when(level <= F.col("fills_at"), level)).over(Window.partitionBy()))
    target = F.when(F.col("fills_at") <= F.coalesce("level", F.lit(math.inf)), cap).otherwise(F.col("weight") * F.col("level"))
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= cap, F.lit(ceiling)).otherwise(F.col("target") / F.col("source_size"))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
    """Settle all but two of a block's probabilities, in place, keeping sum(p) and sum(p x size)."""
    p_, s_, d_ = p.tolist(), size.tolist(), draw.tolist()
    hand: list[int] = []
    for i in range(len(p_)):
        if EDGE < p_[i] < 1 - EDGE:
            hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (s_[b] - s_[c], s_[c] - s_[a], s_[a] - s_[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p_[k]) / v if v > 0 else p_[k] / -v for k, v in zip(hand, u, strict=True) if v)
        down = min(p_[k] / v if v > 0 else (1 - p_[k]) / -v for k, v in zip(hand, u, strict=True) if v)
        step = up if d_[i] * (up + down) < down else -down  # a martingale: up with probability down / (up + down)
        for k, v in zip(hand, u, strict=True):
            x = p_[k] + step * v
            p_[k] = 0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x
        hand = [k for k in hand if 0 < p_[k] < 1]
    p[:] = p_


def landing(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
    """Settle the last two: both keep their probability, and the expected error in words is the least."""
    rest = [i for i in range(len(p)) if 0 < p[i] < 1]
    if len(rest) == 1:
        p[rest[0]] = float(draw[rest[0]] < p[rest[0]])
    elif rest:
        i, j = rest
        goal = p[i] * size[i] + p[j] * size[j]
        cost = [abs(size[i] + size[j] - goal) + abs(goal), abs(size[i] - goal) + abs(size[j] - goal)]
        both = max(0.0, p[i] + p[j] - 1) if cost[1] <= cost[0] else min(p[i], p[j])
        edges = np.cumsum([both, p[i] - both, p[j] - both])
        p[i], p[j] = [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)][int(np.searchsorted(edges, draw[i], side="right"))]


def _fly(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "size"], kind="stable").reset_index(drop=True)
        p, size, draw = (rows[c].to_numpy(dtype=float).copy() for c in ("p", "size", "draw"))
        flight(p, size, draw)
        if last:
            landing(p, size, draw)
        rows["p"] = p
        return rows

    return run


def numbered(sized: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, and order: a hash that differs between repeats of a row.

    Repeats are counted and laid out again with running numbers, so however many there are, no task holds them and no window runs over them.
    """
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    rows = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n") - 1, F.col("run") * RUN + (RUN - 1)))))
    return rows.select("doc_id", "source", "size", F.when(F.col("nth") == 0, F.xxhash64("doc_id", "size")).otherwise(
        F.xxhash64("doc_id", "size", "nth")).alias("order"))


def mix_sources(docs: DataFrame, ceiling: float = CEILING, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of `docs` (doc_id, source, text, ...).

    size is the words of the text (NULL: 0), copies how often the mix takes the document (at most `ceiling`), taken its
    words. Repeated rows are mixed one by one. An empty table gives an empty result; a mix without words takes nothing.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stored(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = stored(source_targets(totals.select("source", "source_size"), ceiling).join(
        totals.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    most = plan.agg(F.max("rows")).first()[0] or 0
    key = F.col("order")
    rows = numbered(sized).join(plan.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumns({
        "whole": F.floor("rate"), "p": F.col("rate") - F.floor("rate"),
        "draw": F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(1 << 52)) / F.lit(float(1 << 52))})
    columns = "doc_id long, source string, size long, source_size long, target double, rows long, whole long, p double, order long, draw double, block long"
    blocks, settled = math.ceil(most / block), None
    n = F.ceil(F.col("rows") / block)
    while True:
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "order"), F.greatest(n, F.lit(1))))
        last = blocks <= 1
        flown = stored(rows.select(*(c.split()[0] for c in columns.split(", "))).groupBy("source", "block").applyInPandas(_fly(last), columns))
        done = flown if last else flown.filter("p IN (0, 1)")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        rows, blocks = flown.filter("p NOT IN (0, 1)").drop("block"), math.ceil(blocks * 2 / block)
        n = F.ceil(n * 2 / block)  # so many blocks hold the two open rows of each block before
    copies = F.col("whole") + F.col("p").cast("long")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
