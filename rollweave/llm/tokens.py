"""Token ids of whole texts by the tokenizers library, with a cache of pre-tokens."""

from __future__ import annotations

import os
import re

import numpy as np
import regex

# The byte-level pre-token pattern that byte-level BPE files use.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
# Letters whose lower case depends on where they stand.
UNLIKE_ALONE = re.compile("[\u0130\u03a3]")

# Pieces that a worker keeps: pre-tokens, and whole words with their punctuation.
CACHED_PIECES = 700_000
CACHED_WHOLE = 250_000
# Words that the library gets as one text; most of its time on a word alone is not spent on the word.
JOINED = 64


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers.

    A text is cut into pieces that the tokenizer treats independently; a piece's ids come from the
    library once and are then cached (bounded). Texts for which the cut isn't certain, such as those that
    hold special strings, go to the library whole. kind: "byte" for byte-level BPE, "word" for BPE with
    word ends that drops white space.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.cache: dict[str, bytes] = {}
        self.whole_kept = 0
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.ends_word = self._word_ends() if kind == "word" else None
        self.byte_level = regex.compile(BYTE_LEVEL)

    def _word_ends(self) -> np.ndarray | None:
        """Of each id, whether its token ends a word; None where words cannot be told apart once joined by blanks."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or any(re.search(r"\s", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def pieces(self, text: str) -> list[str] | None:
        if self.special.search(text):
            return None
        if self.kind == "byte":
            return self.byte_level.findall(text)
        if ODD_SPACE.search(text):
            return None
        return (text if UNLIKE_ALONE.search(text) else text.lower()).split()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [[] if t is None else self.pieces(t) for t in texts]
        found = looked_up([c or [] for c in cut], self.cache, self._ids, keep=self.kind == "byte" or self.whole_kept < CACHED_WHOLE)
        return [self.whole(t) if c is None else b"".join(f) for t, c, f in zip(texts, cut, found, strict=True)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if self.kind == "byte":
            return self._from_library(pieces)
        # Full stops and commas after a letter or digit are a pre-token of their own; the parts are always cached.
        parts = []
        for piece in pieces:
            core = piece.rstrip(".,")
            parts.append((core, piece[len(core) :]) if core != piece and core and core[-1].lower().isalnum() else (piece,))
        lacking = list({p for part in parts for p in part if p not in self.cache})
        new = dict(zip(lacking, self._from_library(lacking), strict=True))
        if len(self.cache) + len(new) <= CACHED_PIECES:
            self.cache.update(new)
        self.whole_kept += sum(len(part) > 1 for part in parts)
        return [b"".join([new[p] if p in new else self.cache[p] for p in part]) for part in parts]

    def _from_library(self, pieces: list[str]) -> list[bytes]:
        if self.ends_word is None:
            return self._one_by_one(pieces)
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        coded = dict(zip([*words, *others], [*self._joined(words), *self._one_by_one(others)], strict=True))
        return [coded[p] for p in pieces]

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.array(got.ids, dtype="<u4").tobytes() for got in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each at least one pre-token: with as many word ends as words, each is exactly one."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        out = []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) == len(group) and ends[-1] == ids.nbytes:
                coded = ids.tobytes()
                out += [coded[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._one_by_one(group)
        return out


def looked_up(cut: list[list[str]], cache: dict, work_out, keep: bool = True) -> list[list]:
    """The value of each piece of each list. work_out gives the values of new pieces; with keep, the cache takes them while it has room."""
    found = [list(map(cache.get, c)) for c in cut]
    lacking = [k for k, f in enumerate(found) if None in f]
    missing = list({p for k in lacking for p, v in zip(cut[k], found[k], strict=True) if v is None})
    new = {}
    for at in range(0, len(missing), 5000):
        some = missing[at : at + 5000]
        new.update(zip(some, work_out(some), strict=True))
    for k in lacking:
        found[k] = [new[p] if v is None else v for p, v in zip(cut[k], found[k], strict=True)]
    if keep and len(cache) + len(new) <= CACHED_PIECES:
        cache.update(new)
    return found


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process, kept between its tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
