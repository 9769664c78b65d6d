"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair does.

Each task aligns slices of texts as Arrow tables: the id lists are flattened with their parent indices, cumulative sums of
token lengths within each text give the byte ends, and an Acero hash join on (text, end) finds the ends that both have.
Sorted by end, the row of every end belongs to one token of either side, the next that ends there or later: these are the
links. `Table.group_by` counts them by text and by slice; Spark adds up the counts of the slices.

The counts then go back to the texts. The most frequent pairs, as many as `most_broadcast` at most, go to every worker; what
a text holds of the others is joined by pair.

Texts longer than a window are cut before a blank behind a printable ASCII character. Both vocabularies have a token end
there and encode what follows alike (see `pieces` and `tokens`), so the windows' groups, links and counts add up.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm import bytebpe, pieces
from boutwise.llm.common import slices, stored

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WINDOW = 1 << 20  # characters
SLICE = 2 << 20  # bytes aligned at once
MOST_BROADCAST = 1 << 20  # pairs, of 17 bytes each
COMMA, BAR, SEMICOLON, NOTHING = range(4)
_CUT = re.compile(r"[!-~] ")
_TABLES: dict[tuple[str, str], Tables] = {}


class Ragged:
    """Byte strings by number, to be gathered many at once."""

    def __init__(self, strings: list[bytes]):
        self.flat, self.sizes = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, which: np.ndarray) -> bytes:
        return pieces.ragged(self.flat, self.starts[which], self.sizes[which]).tobytes()


class Tables:
    """Both vocabularies, the bytes of their ids, and the ids in decimal before each separator."""

    def __init__(self, a: str, b: str):
        self.a, self.b = bytebpe.load(a), pieces.load(b)
        self.raw_a, self.raw_b = Ragged(self.a.raw), Ragged(self.b.raw)
        self.most = max(len(self.a.raw), len(self.b.raw))
        self.decimal = Ragged([f"{k}{sign}".encode() for sign in (",", "|", ";", "") for k in range(self.most)])

    def ids(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of both sides; none where the joined bytes of either differ from a blank and the text."""
        ours = [self.a.ids(" " + t) if t else np.empty(0, np.uint32) for t in texts]
        bounds_a = np.cumsum([0, *map(len, ours)])
        flat_a = np.concatenate(ours).astype(np.int64)
        flat_b, bounds_b = self.b.encode_all(texts)
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        keeps = np.ones(len(texts), bool)
        for raw, flat, bounds in ((self.raw_a, flat_a, bounds_a), (self.raw_b, flat_b, bounds_b)):
            joined = raw.take(flat)
            if joined != b"".join(wanted):
                ends = np.r_[0, np.cumsum(raw.sizes[flat])][bounds].tolist()
                keeps &= [joined[x:y] == w for x, y, w in zip(ends, ends[1:], wanted, strict=False)]
        out = []
        for flat, bounds in ((flat_a, bounds_a), (flat_b, bounds_b)):
            sizes = np.diff(bounds)
            out.append(pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.where(keeps, sizes, 0))].astype(np.int32)), pa.array(flat[np.repeat(keeps, sizes)])))
        return out[0], out[1]

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text; a pair is id A << 32 | id B."""
        n = len(texts)
        list_a, list_b = self.ids(texts)
        side_a, side_b = ends_of(list_a, self.raw_a.sizes, "a"), ends_of(list_b, self.raw_b.sizes, "b")
        both = side_a.join(side_b, ["text", "end"], join_type="full outer", use_threads=False)
        both = both.take(np.lexsort((both["end"].to_numpy(), both["text"].to_numpy())))
        text = both["text"].to_numpy()
        closes = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])).to_numpy(zero_copy_only=False)
        at_a, at_b = (pc.fill_null_backward(both[side]).to_numpy().astype(np.int64) for side in "ab")
        flat_a, flat_b = pc.list_flatten(list_a).to_numpy(), pc.list_flatten(list_b).to_numpy()
        links = pa.table({"text": text, "pair": flat_a[at_a] << 32 | flat_b[at_b]}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        groups = self.written(flat_a, flat_b, at_a, at_b, closes, text)
        links = links.take(np.lexsort((links["pair"].to_numpy(), links["text"].to_numpy())))
        held = np.bincount(links["text"].to_numpy(), minlength=n)
        until, pair, times = np.cumsum(held), links["pair"].to_numpy(), links["count_all"].to_numpy()
        return list(zip(
            pc.list_value_length(list_a).to_pylist(), pc.list_value_length(list_b).to_pylist(), np.bincount(text[closes], minlength=n).tolist(),
            np.bincount(text, minlength=n).tolist(), groups(n), [pair[e - h:e] for e, h in zip(until, held, strict=True)],
            [times[e - h:e] for e, h in zip(until, held, strict=True)], strict=True))

    def written(self, flat_a, flat_b, at_a, at_b, closes, text):
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        first = np.r_[True, closes[:-1]] if len(closes) else closes
        group = np.cumsum(first) - 1  # of each link
        of_a, of_b = (np.empty(len(flat), np.int64) for flat in (flat_a, flat_b))
        of_a[at_a], of_b[at_b] = group, group
        text_of = text[first]  # of each group
        place_a = np.arange(len(flat_a)) + np.searchsorted(of_b, of_a, "left")
        place_b = np.arange(len(flat_b)) + np.searchsorted(of_a, of_b, "right")
        last_a, last_b = (np.r_[x[1:] != x[:-1], True] if len(x) else np.empty(0, bool) for x in (of_a, of_b))
        final = np.r_[text_of[1:] != text_of[:-1], True] if len(text_of) else np.empty(0, bool)
        which = np.empty(len(flat_a) + len(flat_b), np.int64)
        which[place_a] = flat_a + self.most * np.where(last_a, BAR, COMMA)
        which[place_b] = flat_b + self.most * np.where(last_b, np.where(final[of_b], NOTHING, SEMICOLON), COMMA)
        written, owner = self.decimal.take(which), np.empty(len(which), np.int64)
        owner[place_a], owner[place_b] = text_of[of_a], text_of[of_b]

        def split(n: int) -> list[bytes]:
            ends = np.cumsum(np.bincount(owner, self.decimal.sizes[which], minlength=n)).astype(np.int64).tolist()
            return [written[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        return split


def ends_of(lists: pa.ListArray, lengths: np.ndarray, side: str) -> pa.Table:
    """text, end, and the place of the token that ends there: a cumulative sum of lengths within each text."""
    parent, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    total = pc.cumulative_sum(pc.take(pa.array(lengths), ids)) if len(ids) else pa.array([], pa.int64())
    before = np.r_[0, total.to_numpy()][lists.offsets.to_numpy()]  # what the texts in front take
    return pa.table({"text": parent, "end": pc.subtract(total, pa.array(before[parent.to_numpy()])), side: pa.array(np.arange(len(ids)))})


def tables(a: str, b: str) -> Tables:
    if (a, b) not in _TABLES:
        _TABLES[a, b] = Tables(a, b)
    return _TABLES[a, b]


def windows(text: str, size: int) -> list[str]:
    """Parts of `text` that joined by one blank give it back, and whose alignments joined are its alignment."""
    parts, start = [], 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)) and cut.end() < len(text):
        parts.append(text[start:cut.end() - 1])
        start = cut.end()
    parts.append(text[start:])
    return parts


LISTS = pa.list_(pa.int64())
ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _counted(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same pairs added up."""
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = pa.table({"pair": np.concatenate(pairs), "times": np.concatenate(times)}).group_by("pair", use_threads=False).aggregate([("times", "sum")])
    return found["pair"].to_numpy(), found["times_sum"].to_numpy()


def _chunks(units: list[str], most: int) -> Iterator[list[str]]:
    chunk, size = [], 0
    for unit in units:
        if chunk and size + len(unit) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(unit)
        size += len(unit)
    yield chunk


def _align(a: str, b: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = tables(a, b), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE):
            parts = [windows(t or "", window) for t in batch.column("text").to_pylist()]
            found = (x for chunk in _chunks([p for part in parts for p in part], SLICE) for x in both.align(chunk))
            rows, every = [], []
            for part in parts:
                sums, digest, pairs, times = np.zeros(4, np.int64), hashlib.sha256(), [], []
                for k, (unit, got) in enumerate(zip(part, found, strict=False)):
                    if unit and not got[0]:  # its bytes differ, so the whole text has no tokens
                        sums[:] = -1
                    if sums[0] < 0:
                        continue
                    sums += got[:4]
                    digest.update(b";" * (k > 0) + got[4])
                    pairs.append(got[5])
                    times.append(got[6])
                if sums[0] <= 0:
                    rows.append((row, 0, 0, 0, 0, "", *_counted([], [])))
                else:
                    rows.append((row, *sums.tolist(), digest.hexdigest(), *((pairs[0], times[0]) if len(pairs) == 1 else _counted(pairs, times))))
                    every.append(rows[-1])
                row += 1
            counts = _counted([r[6] for r in every], [r[7] for r in every])
            # The last row carries the counts of the slice.
            rows.append((None, None, None, None, None, None, *counts))
            ids = pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, batch.column("doc_id").type)])
            kinds = (*[pa.int64()] * 5, pa.string(), LISTS, LISTS)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links in the whole corpus) and best (whether no other pair of its B id has more)."""
    counts = stored(aligned.filter("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(
        F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")))
    side_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(side_b.alias("b")).agg(F.max("n").alias("most"))  # at most one row per id of the vocabulary
    return counts.join(F.broadcast(highest), side_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two that no more than `most` pairs reach with their counts; 1 if all pairs fit."""
    steps = F.floor(F.log2("n")).cast("int")
    by_step = {r.step: r.pairs for r in counts.groupBy(steps.alias("step")).agg(F.count("*").alias("pairs")).collect()}  # 63 rows at most
    total, least = 0, 1
    for step in sorted(by_step, reverse=True):
        total += by_step[step]
        if total > most:
            return 2 << step
        least = 1 if step == min(by_step) else 1 << step
    return least


_SHARED: dict[str, tuple] = {}


def _look_up(shared, key: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SHARED:
            _SHARED.clear()
            _SHARED[key] = shared.value
        known, counts, best = _SHARED[key]
        for batch in batches:
            pairs, times = batch.column("pairs"), pc.list_flatten(batch.column("times")).to_numpy()
            parent, flat = pc.list_parent_indices(pairs).to_numpy(), pc.list_flatten(pairs).to_numpy()
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            count_sum, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count_sum, parent[hit], times[hit] * counts[at[hit]])
            np.add.at(n_best, parent[hit], times[hit] * best[at[hit]])
            held = np.r_[0, np.cumsum(np.bincount(parent[~hit], minlength=batch.num_rows))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(held), pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_best), pa.array(count_sum), *rest],
                                             names=[*names, "n_best", "count_sum", "pairs", "times"])

    return run


def align_tokens(docs: DataFrame, a: str = A, b: str = B, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of `docs` (doc_id, text, ...).

    Texts that are NULL or empty, or whose tokens of either side do not join to a blank and the text, have no tokens: zeros
    and ''. Repeated rows count each, NULL ids stand for themselves, other columns are left out, an empty table gives none.
    Ties for the highest count of a B id are all best. Memory is bounded by a slice of two megabytes or the longest run
    without a blank behind a printable ASCII character, and by `most_broadcast` pairs.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    aligned = stored(docs.mapInArrow(_align(a, b, window), f"doc_id {kind}, {ALIGNED}"))
    counts = stored(pair_counts(aligned))
    least = least_count(counts, most_broadcast)
    often = counts.filter(F.col("n") >= least).toPandas().sort_values("pair")  # no more rows than most_broadcast
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), often["best"].to_numpy(bool)))
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    summed = aligned.filter("row IS NOT NULL").mapInArrow(
        _look_up(shared, uuid.uuid4().hex, names), f"{schema}, n_best long, count_sum long, pairs array<long>, times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # every pair was looked up
        return summed.select(*out)
    summed = stored(summed)
    seldom = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = seldom.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    return summed.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*out)
