"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text's symbols are its characters, blanks written as U+2581 behind one more in front. The agenda holds every adjacent
pair whose concatenation is a piece, highest score first and leftmost among equals; the top pair is merged and the pairs with
its new neighbours join the agenda, until none is left. A symbol that is no piece falls back to its bytes.

No piece of such a vocabulary may hold a blank behind another character, so nothing merges across that place. Texts are cut
there into segments (a word with its blanks), which repeat and are remembered, and very long texts into windows before that.
ASCII signs that no piece holds together with another character are segments of their own, and those that no piece holds
behind a letter begin a new one. `Pieces` reads these sets off the vocabulary, and refuses those with a blank inside a piece,
unused pieces or an input normaliser.

Each Arrow batch is encoded and decoded by the sentencepiece library as well, and `agrees` says whether both are equal.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boutwise.llm.common import slices

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 1 << 20  # characters; a longer text is cut at the next blank behind another character
REMEMBERED, SHORT = 400_000, 48  # segments whose ids a worker keeps, none longer than the second
BLANK = "▁"  # fixed value: how the library writes a blank
LETTER = r"[^\W\d_]"
NO_PAIR, NO_RANK = (1 << 63) - 1, 1 << 30
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """A merge-type vocabulary, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.names = [model.id_to_piece(k) for k in every]
        reserved = {k for k in every if model.is_byte(k) or model.is_control(k) or model.is_unknown(k)}
        normal = {p: k for k, p in enumerate(self.names) if k not in reserved}
        probe = " a  b\t\n　cﬁ Ａ é  "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("the vocabulary rewrites its input")
        if any(model.is_unused(k) for k in every) or any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("pieces that are unused, or hold a blank behind another character")
        if not any(map(model.is_byte, every)):
            raise ValueError("the vocabulary has no byte pieces")
        best_first = {s: r for r, s in enumerate(sorted({model.get_score(k) for k in normal.values()}, reverse=True))}
        self.ranks = {p: best_first[model.get_score(k)] for p, k in normal.items() if len(p) > 1}
        self.ids = normal
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []  # what each id stands for
        for k, name in enumerate(self.names):
            if model.is_byte(k):
                value = int(name[3:5], 16)
                self.byte_ids[value] = k
                self.raw.append(bytes([value]))
            elif model.is_unknown(k):
                self.raw.append(model.decode([k]).encode())
            else:
                self.raw.append(b"" if k in reserved else name.replace(BLANK, " ").encode())
        self.is_byte = [model.is_byte(k) for k in every]
        self.is_control = [model.is_control(k) for k in every]
        ascii_signs = [chr(c) for c in range(128) if c != 32 and not chr(c).isalpha()]
        merged = {c for p in normal if len(p) > 1 for c in p}
        after_letters = {b for p in normal for a, b in zip(p, p[1:], strict=False) if re.match(LETTER, a)}
        alone = re.escape("".join(c for c in ascii_signs if c not in merged))
        ends = re.escape("".join(c for c in ascii_signs if c not in after_letters))
        self.unknown = re.compile("[^ " + re.escape("".join(p for p in normal if len(p) == 1)) + "]").search
        self.segments = re.compile((f"[{alone}]|" if alone else "") + f" *{LETTER}++(?=[ {ends}]|\\Z)| *[^ {alone}]+| +").findall
        self.forget()
        self.raw_flat, self.raw_sizes = np.frombuffer(b"".join(self.raw), np.uint8), np.array(list(map(len, self.raw)))
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.leads = np.array([n.startswith(BLANK) and not k for n, k in zip(self.names, self.is_control, strict=True)])
        # The same pairs by id: every split of a piece into two others. Segments with a character that is no piece go to `merge`.
        self.of_char = np.full(0x110000, -1, np.int64)
        for symbol, k in normal.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = k
        self.of_char[32] = self.of_char[ord(BLANK)]
        splits = sorted((normal[p[:at]] << 32 | normal[p[at:]], k, self.ranks[p]) for p, k in normal.items() for at in range(1, len(p))
                        if p[:at] in normal and p[at:] in normal)
        self.pairs, self.pair_ids, self.pair_ranks = np.array([*splits, (NO_PAIR, -1, NO_RANK)], np.int64).T

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in `pairs`; the last place where two symbols make no piece."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, at, len(self.pairs) - 1)

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each has): `merge` of many short segments at once; a round pops the top pair of each agenda."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        symbols, last = self.of_char[codes], len(self.pairs) - 1
        pair = np.full(len(symbols), last)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pair[inner] = self._found(symbols[inner], symbols[inner + 1])
        done_owner, done = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(self.pair_ranks[pair] << 32 | np.arange(len(pair)), starts)
            live = best >> 32 < NO_RANK
            at = best[live] & 0xFFFFFFFF
            stays = np.repeat(live, np.diff(np.r_[starts, len(owner)]))
            done_owner.append(owner[~stays])
            done.append(symbols[~stays])
            symbols[at] = self.pair_ids[pair[at]]
            pair[at] = last
            after, before = at + 2, at - 1
            some = np.flatnonzero((after < len(owner)) & (owner[np.minimum(after, len(owner) - 1)] == owner[at]))
            pair[at[some]] = self._found(symbols[at[some]], symbols[after[some]])
            some = np.flatnonzero((before >= 0) & (owner[before] == owner[at]))
            pair[before[some]] = self._found(symbols[before[some]], symbols[at[some]])
            stays[at + 1] = False
            owner, symbols, pair = owner[stays], symbols[stays], pair[stays]
        owner = np.concatenate([owner, *done_owner])
        return np.concatenate([symbols, *done])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(segments))

    def forget(self) -> None:
        self.codes: dict[str, int] = {}  # segment -> its place in `sizes` and `starts`
        self.flat, self.sizes, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def remember(self, segments: set[str]) -> None:
        """Find the ids of what is not remembered yet."""
        new = segments - self.codes.keys()
        if len(self.codes) + len(new) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self.forget()
            new = segments
        short = [s for s in new if len(s) <= SHORT and not self.unknown(s)]
        rest = [s for s in new if len(s) > SHORT or self.unknown(s)]
        ids, sizes = self.merge_all(short)
        others = [self.merge(s) for s in rest]
        self.codes.update(zip(chain(short, rest), range(len(self.sizes), len(self.sizes) + len(new)), strict=False))
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(others), np.int64)])
        self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, others), np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): text k has the ids from bounds[k] to bounds[k + 1]."""
        cut = [self.segments(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        self.remember(distinct)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(cut)), np.int64)
        sizes = self.sizes[codes]
        bounds = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, cut)])]
        ids = ragged(self.flat, self.starts[codes], sizes)
        for segment in distinct:
            if len(segment) > SHORT:
                del self.codes[segment]
        return ids, bounds

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """`decode` of each text's ids."""
        sizes = self.raw_sizes[ids]
        raw = ragged(self.raw_flat, self.raw_starts[ids], sizes).tobytes()
        ends = np.r_[0, np.cumsum(sizes)][bounds].tolist()
        out = []
        for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            try:
                if a < b and self.is_control[ids[a]]:
                    raise ValueError
                out.append(raw[ends[k] + int(a < b and self.leads[ids[a]]):ends[k + 1]].decode())
            except ValueError:  # also what is no UTF-8
                out.append(self.decode(ids[a:b].tolist()))
        return out

    def merge(self, segment: str) -> tuple[int, ...]:
        """The ids of one segment, by the agenda. An entry is the pair's rank above its left place."""
        symbols = list(segment.replace(" ", BLANK))
        n, rank_of = len(symbols), self.ranks.get
        agenda = [r << 40 | at for at in range(n - 1) if (r := rank_of(symbols[at] + symbols[at + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                entry = heapq.heappop(agenda)
                at = entry & 0xFFFFFFFFFF
                left, right = symbols[at], after[at]
                if not left or right >= n or rank_of(left + symbols[right]) != entry >> 40:
                    continue  # one of the two has been merged since
                symbols[at] = left = left + symbols[right]
                symbols[right] = ""
                after[at] = right = after[right]
                if right < n:
                    before[right] = at
                    r = rank_of(left + symbols[right])
                    if r is not None:
                        heapq.heappush(agenda, r << 40 | at)
                at = before[at]
                if at >= 0:
                    r = rank_of(symbols[at] + left)
                    if r is not None:
                        heapq.heappush(agenda, r << 40 | at)
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                k = self.ids.get(symbol)
                if k is None:
                    out += [self.byte_ids[b] for b in symbol.encode()]
                else:
                    out.append(k)
        return tuple(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the blank in front goes, and each byte that is not part of a character becomes U+FFFD."""
        parts = list(map(self.raw.__getitem__, ids))
        first = next((at for at, k in enumerate(ids) if not self.is_control[k]), None)
        if first is not None and not self.is_byte[ids[first]] and self.names[ids[first]].startswith(BLANK):
            parts[first] = parts[first][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for k, part in zip([*ids, None], [*parts, b""], strict=True):
            if k is not None and self.is_byte[k]:
                run += part
                continue
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as bad:
                    out.append(run[:bad.start].decode() + "�")
                    run = run[bad.start + 1:]
            out.append(part.decode())
        return "".join(out)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of all, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


def load(name: str) -> Pieces:
    """The vocabulary at `public_tokenizers.path(name)`, loaded once per worker."""
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Pieces(public_tokenizers.path(name))
    return _LOADED[name]


_CUT = re.compile(f"[^ {BLANK}] ")


def windows(text: str, size: int = WINDOW) -> list[str]:
    """Parts of `text` that joined by one blank give it back, and whose ids joined are its ids."""
    parts, start = [], 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)) and cut.end() < len(text):
        parts.append(text[start:cut.end() - 1])
        start = cut.end()
    parts.append(text[start:])
    return parts


def _round_trip(name: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(name)
        for batch in slices(batches, "text"):
            parts = [windows(text or "", window) for text in batch.column("text").to_pylist()]
            flat = list(chain.from_iterable(parts))
            ids, bounds = pieces.encode_all(flat)
            decoded = pieces.decode_all(ids, bounds)
            theirs = pieces.library.encode(flat, num_threads=1)
            back = pieces.library.decode(theirs, num_threads=1)
            same = [np.array_equal(ids[a:b], x) and y == z for a, b, x, y, z in zip(
                bounds.tolist(), bounds[1:].tolist(), theirs, decoded, back, strict=False)]
            ends = np.cumsum([0, *map(len, parts)])
            spans = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
            texts, agrees = [" ".join(decoded[a:b]) for a, b in spans], [all(same[a:b]) for a, b in spans]
            lists = pa.ListArray.from_arrays(pa.array(bounds[ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), lists, pa.array(texts, pa.string()), pa.array(agrees, pa.bool_())],
                names=[*(c for c in batch.schema.names if c != "text"), "ids", "decoded", "agrees"])

    return run


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """doc_id, ids, decoded and agrees for every row of `docs` (doc_id, text, ...).

    `ids` are the text's pieces without begin and end, `decoded` the text they give back, and `agrees` tells whether the
    library gives both alike. NULL and empty texts have no ids and give the empty text; repeated rows and NULL ids stand
    for themselves; other columns are left out. U+2581 in a text is a blank to the library and comes back as one. Memory
    is bounded by four megabytes of texts or one text, whose longest run without a blank takes about 200 bytes a character.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_round_trip(vocabulary, window), f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")
