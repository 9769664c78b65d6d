"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Training words stream through the automaton; after each word its state and match length name the longest suffix of the
text so far that some item contains. Once that length reaches the window, all of the matched words are hit. Items
shorter than a window count as one window and are found at their own state among the suffixes.

A word no item holds, or a pair no item holds, ends every match, so only runs without one, as long as the shortest
window, are streamed; the rest of the text cannot hold a hit.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import discard, encoded, slices, stored

WINDOW = 10
SHARD_WORDS = 200_000  # of items in one automaton, which takes about 180 MB; more items go in several passes
#: All bytes that separate words become blanks: the contract's complement of digits, letters and everything beyond ASCII.
SEPARATORS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(SEPARATORS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, items: list[tuple[int | str | None, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words_of(raw)]) for item, raw in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        self.windows: dict[int, set[str]] = {}  # state -> items whose window it is; all of one length per state
        self.window_length: dict[int, int] = {}
        self.shortest = min((min(len(t), window) for _, t in texts if t), default=window)
        for item, text in texts:
            size = min(window, len(text))
            for end, (state, length) in enumerate(self._run(text), 1):
                if size and end >= size:
                    state = self._cut(state, length, size)
                    self.windows.setdefault(state, set()).update([] if item is None else [str(item)])
                    self.window_length.setdefault(state, size)
        # A state may be the window of a short item and hold longer strings too; the marks on its suffixes, longest first.
        self.marks: list[list[int]] = [[] for _ in self.link]
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.marks[self.link[state]] if state else []
            self.marks[state] = [state, *up] if state in self.windows else up
        pairs = {a * len(self.ids) + b for _, t in texts for a, b in zip(t, t[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, word: int) -> int:
        step = self.next[last].get(word)
        if step is not None:  # the string is there already: reuse its state, or split off the part that ends here
            return step if self.length[step] == self.length[last] + 1 else self._split(last, word, step)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            step = self.next[last][word]
            self.link[state] = step if self.length[step] == self.length[last] + 1 else self._split(last, word, step)
        return state

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, last: int, word: int, step: int) -> int:
        copy = self._new(self.length[last] + 1, dict(self.next[step]), self.link[step])
        while last >= 0 and self.next[last].get(word) == step:
            self.next[last][word] = copy
            last = self.link[last]
        self.link[step] = copy
        return copy

    def _cut(self, state: int, length: int, size: int) -> int:
        """The state that holds the last `size` words of a match."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _run(self, words):
        """(state, match length) after each word."""
        moves, link, lengths, state, length = self.next, self.link, self.length, 0, 0
        for word in words:
            step = moves[state].get(word)
            if step is not None:
                state, length = step, length + 1
            else:
                while state >= 0 and word not in moves[state]:
                    state = link[state]
                if state < 0:
                    state = length = 0
                else:
                    length = lengths[state] + 1
                    state = moves[state][word]
            yield state, length

    def hits(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, hit spans [start, end) in words, items with an occurring window) of one text."""
        words = words_of(raw)
        known = self.ids.get
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in self._candidates(ids):
            for at, (state, length) in enumerate(self._run(ids[start:end].tolist()), start + 1):
                for mark in self.marks[state]:
                    size = self.window_length[mark]
                    if size > length:
                        continue
                    # A window of full length: all the matched words lie in windows.
                    span = (at - (length if size == self.window else size), at)
                    items |= self.windows[mark]
                    if spans and span[0] <= spans[-1][1]:
                        while spans and span[0] <= spans[-1][1]:
                            span = (min(span[0], spans[-1][0]), max(at, spans.pop()[1]))
                    spans.append(span)
        return len(words), spans, items

    def _candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of known words whose neighbours are pairs of some item, of the shortest window's length or more."""
        if not len(ids) or not len(self.ids):
            return []
        good = (ids[1:] >= 0) & (ids[:-1] >= 0)
        if len(self.pairs):
            keys = ids[:-1] * len(self.ids) + ids[1:]
            good[good] = self.pairs[np.minimum(np.searchsorted(self.pairs, keys[good]), len(self.pairs) - 1)] == keys[good]
        else:
            good[:] = False
        breaks = np.flatnonzero(~good) + 1
        starts, ends = np.r_[0, breaks], np.r_[breaks, len(ids)]
        keep = (ends - starts >= self.shortest) & (ids[starts] >= 0)
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


#: A word as `words_of` finds it, before letters are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text, size) of the distinct items that have words, those of more than `most` words in pieces of `most`.

    Pieces overlap by one word less than a window and have a window's words at least, so that every window of an item lies in
    one piece and a piece has no other windows.
    """
    step = most - window + 1
    if step < 1:
        raise ValueError("pieces must be longer than a window")
    words = items.select("item_id", "text").filter("text IS NOT NULL").dropDuplicates().withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    starts = F.when(n > most, F.sequence(F.lit(0), n - window, F.lit(step))).otherwise(F.array(F.lit(0)))
    pieces = words.filter(n > 0).select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start") + 1, F.lit(most)).alias("words"))
    return pieces.select("item_id", F.array_join("words", " ").alias("text"), F.size("words").cast("long").alias("size")).dropDuplicates()


def _shard(n: int):
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(n))


def _passes(pieces: DataFrame, shard_words: int) -> int:
    """The least power of two of shards none of which holds more than `shard_words` words."""
    n = 1
    while (pieces.groupBy(_shard(n)).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0) > shard_words:
        n *= 2
    return n


_AUTOMATA: dict[tuple, SuffixAutomaton] = {}


def _built(key: tuple, shared) -> SuffixAutomaton:
    """One automaton per worker, kept for the tasks of the same pass."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = SuffixAutomaton(shared.value, key[1])
    return _AUTOMATA[key]


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
HITS = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _match(frame: DataFrame, shard: list[tuple[int | str | None, bytes]], window: int) -> DataFrame:
    """`frame` (..., text) plus what one automaton finds; the shard is of bounded size (`shard_words`)."""
    shared, key, names = frame.sparkSession.sparkContext.broadcast(shard), (uuid.uuid4().hex, window), frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(key, shared)
        for batch in slices(batches, "text"):
            rows = [automaton.hits(raw) for raw in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in rows], SPANS),
                pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{schema}, {HITS}")


def find_hits(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns `keep` of `docs` (..., text) plus n_words, spans of hit words and items with an occurring window.

    One row per row of `docs`; `items` is (item_id, text). NULL and empty texts have no words, and an item without words
    occurs nowhere. Words of an item without id are hit, but it is not listed. Benchmarks of more than `shard_words` words are matched
    shard by shard, each over all documents and on top of what is known so far, so that rows need no key.
    """
    # Many pieces fill a shard, so that shards of pieces placed by hash come out even.
    pieces = item_pieces(items, window, max(2 * window, shard_words // 8))
    n, columns = _passes(pieces, max(shard_words, 2 * window)), list(dict.fromkeys([*keep, "text"]))
    found, last = docs.select(*columns), None
    for k in range(n):
        shard = [(r.item_id, r.text.encode()) for r in pieces.filter(_shard(n) == k).collect()]  # bounded by shard_words
        if k == 0:
            found = _match(found, shard, window)
        else:
            held = stored(found)
            if last is not None:
                discard(last)
            last = held
            found = _match(held.withColumnsRenamed({"n_words": "n0", "spans": "s0", "items": "i0"}), shard, window).select(
                *columns, "n_words", F.concat("s0", "spans").alias("spans"), F.array_union("i0", "items").alias("items"))
    return found.select(*keep, "n_words", "spans", "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_words(spans) -> F.Column:
    """Words inside the spans of one document, overlaps counted once."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(ordered, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`raw` without the words of the spans and what stands between them; the gap is one blank."""
    if not spans:
        return raw
    places = [m.span() for m in _WORD.finditer(raw)]
    parts, at = [], 0
    for a, b in merged(spans):
        parts.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    parts.append(raw[at:])
    return b" ".join(p.strip() for p in parts if p.strip())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest_span: int = 0, most_coverage: float = 0.0) -> DataFrame:
    """`docs` without benchmark text, in the columns of `docs` (doc_id, text, n_chars, ...).

    A document whose hit words exceed `most_coverage` of all its words is dropped. In the others, spans of more than
    `longest_span` words are cut out. NULL texts have no words and stay.
    """
    columns = docs.columns
    found = find_hits(docs, items, columns, window).withColumn("covered", F.try_divide(hit_words(F.col("spans")), F.col("n_words")))
    kept = found.filter(F.coalesce("covered", F.lit(0.0)) <= most_coverage)
    if most_coverage <= 0:
        return kept.select(*columns)

    @F.pandas_udf("string")
    def without(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or not len(s) else cut_spans(
            t.encode(), [x for x in merged([(y["a"], y["b"]) for y in s]) if x[1] - x[0] > longest_span]).decode())

    cut = without("text", "spans")
    return kept.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
