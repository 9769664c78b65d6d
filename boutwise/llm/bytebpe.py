"""Byte-level BPE vocabularies: ids of a text, and the bytes of each id."""

from __future__ import annotations

import base64
import re

import numpy as np

SPECIAL = {"<|endoftext|>": 50256}  # fixed value: the vocabulary's one special token
_LONG_BLANKS = re.compile(r"\s{100000}")
_LOADED: dict[str, ByteVocabulary] = {}


class ByteVocabulary:
    """The ranks of `<stem>.tiktoken` read by tiktoken, which is the faster library; the tokenizers library reads `<stem>.json`
    for texts with very long runs of blanks, on which the pattern search of the first one overflows. Both give the same ids."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.stem, self.slow = name.rsplit(".", 1)[0], None
        with open(public_tokenizers.path(f"{self.stem}.tiktoken")) as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.raw = [b""] * (self.fast.max_token_value + 1)
        for token, rank in [*ranks.items(), *((t.encode(), r) for t, r in SPECIAL.items())]:
            self.raw[rank] = token

    def ids(self, text: str, special: bool = False) -> np.ndarray:
        """`special`: whether a special token's string in the text is that token, or plain text."""
        if len(text) < 100_000 or not _LONG_BLANKS.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        if self.slow is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(public_tokenizers.path(f"{self.stem}.json"))
        self.slow.encode_special_tokens = not special
        return np.array(self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def load(name: str) -> ByteVocabulary:
    """Loaded once per worker."""
    if name not in _LOADED:
        _LOADED[name] = ByteVocabulary(name)
    return _LOADED[name]
