"""Substring dedup by recompression.

Stage 1 names the symbols of every text (see `recompress`) and keeps those that a window decides alone.
Stage 2 counts them over all texts and hands each text its repeated ones.
Stage 3 names the symbols again: a window holding a symbol that occurs once cannot repeat, so only windows whose symbols all
repeat, or that hold none, are left. Their texts are kept, the others are done.
Stage 4 verifies: 128-bit names of the open windows are counted over all texts. Every occurrence of a repeated window is
open, so a window counted once does not repeat, and its row carries the place. Hot passages meet in partial sums.
Stage 5 removes all words that the other open windows cover.

Joins run on row numbers or on (doc_id, text hash); rows alike in both are copies and fare alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm import recompress
from boutwise.llm.common import discard, encoded, slices, stored

WINDOW = 35
SLICE = 2 << 20


def _words(raws: list[bytes], which: int = 0):
    """Names of all words of some texts, the number of each word's text, and each text's first word."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    at = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    starts, ends = recompress.words_in(data)
    text = np.searchsorted(at, starts, side="right") - 1
    first = np.searchsorted(starts, np.r_[at, len(data)])
    return recompress.word_names(data, starts, ends, which), text, first


def _symbol_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            names, text, _ = _words(encoded(batch.column("text")))
            symbol, text, lo, hi = recompress.symbols(names, text)
            own = hi - lo <= window
            pairs = np.unique(np.rec.fromarrays([text[own], symbol[own]], names="t,s")) if own.any() else None
            counts = np.bincount(pairs.t, minlength=batch.num_rows) if own.any() else np.zeros(batch.num_rows, int)
            values = pairs.s.view(np.int64) if own.any() else np.zeros(0, np.int64)
            # A symbol twice in one text repeats as well: those are told apart here.
            twice = _twice(text[own], symbol[own], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.ascontiguousarray(values))), twice],
                names=["doc_id", "text_hash", "symbols", "twice"])

    return run


def _twice(text: np.ndarray, symbol: np.ndarray, rows: int) -> pa.Array:
    order = np.lexsort((symbol, text))
    t, s = text[order], symbol[order]
    same = np.flatnonzero((t[1:] == t[:-1]) & (s[1:] == s[:-1]))
    pairs = np.unique(np.rec.fromarrays([t[same], s[same]], names="t,s")) if len(same) else None
    counts = np.bincount(pairs.t, minlength=rows) if len(same) else np.zeros(rows, int)
    values = np.ascontiguousarray(pairs.s.view(np.int64)) if len(same) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def open_windows(names: np.ndarray, text: np.ndarray, first: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """Places of the windows that no symbol found only once rules out."""
    if len(names) < window:
        return np.zeros(0, np.int64)
    symbol, _, lo, hi = recompress.symbols(names, text)
    once = (hi - lo <= window) & ~np.isin(symbol, repeated)
    # A symbol inside [lo, hi) rules out the windows that start in [hi - window, lo].
    ruled = np.zeros(len(names) + 1, np.int64)
    np.add.at(ruled, np.maximum(hi[once] - window, 0), 1)
    np.add.at(ruled, lo[once] + 1, -1)
    whole = np.zeros(len(names), bool)
    whole[: len(names) - window + 1] = text[: len(names) - window + 1] == text[window - 1:]
    return np.flatnonzero(whole & (np.cumsum(ruled)[:-1] == 0))


OPEN = "doc_id {kind}, n_words long, kept_sha256 string, text string, at array<int>"


def _open_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raws = encoded(batch.column("text"))
            names, text, first = _words(raws)
            hits = batch.column("hits")
            repeated = np.unique(hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
            at = open_windows(names, text, first, repeated, window)
            counts = np.bincount(text[at], minlength=len(raws)) if len(at) else np.zeros(len(raws), int)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            local = pa.array((at - first[text[at]]).astype(np.int32) if len(at) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(first)),
                pa.array([None if n else hashlib.sha256(b" ".join(r.split())).hexdigest() for n, r in zip(counts, raws, strict=True)], pa.string()),
                pa.array([r.decode() if n else None for n, r in zip(counts, raws, strict=True)], pa.string()),
                pa.ListArray.from_arrays(offsets, local)], names=["doc_id", "n_words", "kept_sha256", "text", "at"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE // 4):
            raws, places = encoded(batch.column("text")), batch.column("at")
            names, _, first = _words(raws)
            counts = np.diff(places.offsets.to_numpy())
            local = places.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(raws)), counts)
            at = local + first[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(recompress.window_names(names, window, at, 0).view(np.int64)),
                pa.array(recompress.window_names(_words(raws, 1)[0], window, at, 1).view(np.int64)),
                pa.array(batch.column("row").to_numpy()[row]), pa.array(local.astype(np.int32))], names=["g", "h", "row", "at"])

    return run


REMOVED = "doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"


def _removed_rows(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = []
            for raw, at, lone in zip(encoded(batch.column("text")), batch.column("at").to_pylist(), batch.column("lone").to_pylist(), strict=True):
                words = raw.split()
                marks = np.zeros(len(words) + 1, np.int64)
                repeated = np.setdiff1d(np.asarray(at, np.int64), np.asarray(lone or [], np.int64), assume_unique=True)
                np.add.at(marks, repeated, 1)
                np.add.at(marks, repeated + window, -1)
                stay = np.cumsum(marks)[:-1] == 0
                kept = b" ".join(compress(words, stay.tolist()))
                out.append((len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for every row of `docs` (doc_id, text, ...).

    A word goes if a window of `window` words over it starts anywhere else too, in the same text or another. kept_sha256 is of
    the kept words joined by one blank; `kept` holds them where `texts` asks for it and words were removed or might have
    been, else NULL. NULL texts have no words. Repeated rows repeat all their windows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    named = stored(keyed.mapInArrow(_symbol_rows(window), f"doc_id {kind}, text_hash long, symbols array<long>, twice array<long>").withColumn(
        "row", F.monotonically_increasing_id()))
    each = named.select("row", F.explode("symbols").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s").unionByName(named.select(F.explode("twice").alias("s"))).distinct()
    hits = each.join(often, "s").groupBy("row").agg(F.collect_list("s").alias("hits"))
    hits = named.select("row", F.col("doc_id").alias("d2"), F.col("text_hash").alias("t2")).join(hits, "row")
    hits = stored(hits.drop("row").dropDuplicates(["d2", "t2"]))
    discard(named)
    ready = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("t2")), "left").select(
        "doc_id", "text", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"))
    found = stored(ready.mapInArrow(_open_rows(window), OPEN.format(kind=kind)).withColumn("row", F.monotonically_increasing_id()))
    discard(hits)
    still = found.filter("text IS NOT NULL")
    windows = still.select("row", "text", "at").mapInArrow(_window_rows(window), "g long, h long, row long, at int")
    once = windows.groupBy("g", "h").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).filter("n = 1")
    lone = stored(once.groupBy("row").agg(F.collect_list("at").alias("lone")))
    removed = still.join(lone, "row", "left").select("doc_id", "text", "at", "lone").mapInArrow(_removed_rows(window, texts), REMOVED.format(kind=kind))
    done = found.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return done.unionByName(removed)
