"""Packing, token files and token counts against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from tokenizers import Tokenizer

from rollweave.llm import packing, token_counts, token_files
from rollweave.llm.token_files import packed, unpacked
from rollweave.llm.tokens import Encoder, encoder

BYTE, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
CASES = {"test table": brute.documents, "awkward": brute.awkward, "empty": list}


def ids_of(path, rows):
    tokenizer = Tokenizer.from_file(path)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(params=CASES)
def rows(request):
    return CASES[request.param]()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbB'sdl.,!?|_-09 \n\t\r\x1c\x85 ́éİΣ中½​<>|endoftext")), max_size=60))
def test_cached_pieces_equal_the_library(text):
    for path, kind in ((BYTE, "byte"), (WORDS, "word")):
        got = np.frombuffer(encoder(path, kind).encode([text])[0], dtype="<u4").tolist()
        assert got == _LIBRARY[kind].encode(text, add_special_tokens=False).ids
    assert token_counts.merger(BYTE).count([text]) == [len(_LIBRARY["byte"].encode(text, add_special_tokens=False).ids)]


_LIBRARY = {"byte": Tokenizer.from_file(BYTE), "word": Tokenizer.from_file(WORDS)}


def test_token_counts(spark, rows):
    want = {i: (len((t or "").encode()), len(_LIBRARY["byte"].encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    got = brute.rows_by_id(token_counts.token_counts(brute.frame(spark, rows), BYTE))
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())


def test_merging_ties_and_runs():
    merger = token_counts.merger(BYTE)
    some = ["a" * n for n in range(1, 70)] + ["abab" * 9, " " * 33, "\n" * 12, "<<<<>>>>"]
    assert merger.symbols([s.encode() for s in some]).tolist() == [len(_LIBRARY["byte"].encode(s, add_special_tokens=False).ids) for s in some]


@pytest.mark.parametrize("limit", [1024, 48])
def test_packing(spark, rows, limit):
    want = ids_of(BYTE, rows)
    placed = packing.pack(brute.frame(spark, rows), BYTE, limit).collect()
    sequences: dict[int, list] = {}
    total = {i: 0 for i in want}
    for r in placed:
        ids = [*want[r.doc_id], 2]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert r.length == limit or r.piece == 0
        total[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {i: len(ids) + 1 for i, ids in want.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= limit
    assert len(sequences) <= 1.05 * -(-sum(total.values()) // limit) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_bins_hold_every_piece_once(counts):
    bins = packing.plan_bins(counts, 40)
    held: dict[int, int] = {}
    for times, lengths in bins:
        assert times > 0 and sum(lengths) <= 40
        for n in lengths:
            held[n] = held.get(n, 0) + times
    assert held == counts


def test_two_fit_replaces_the_smallest():
    # 60 leaves 40; greedy takes 30; 20 and 19 fit the gap of 40 more tightly.
    assert packing.plan_bins({60: 1, 30: 1, 20: 1, 19: 1}, 100)[0] == (1, [60, 20, 19])


def test_token_files(spark, rows):
    want, start = {}, 0
    for i, ids in sorted(ids_of(WORDS, rows).items()):
        want[i] = (start, len(ids) + 1, crc([*ids, 1]))
        start += len(ids) + 1
    got = brute.rows_by_id(token_files.round_trip(brute.frame(spark, rows), WORDS))
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=700), st.integers(5, 16))
def test_huffman_round_trip(ids, max_bits):
    counts = np.bincount(np.array(ids, dtype=np.int64), minlength=31) ** 3
    lengths = token_files.code_lengths(counts, max_bits)
    assert lengths.max(initial=0) <= max_bits and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    coded = token_files.encode_block(np.array(ids, dtype="<u4"), lengths, token_files.code_words(lengths))
    assert token_files.Decoder(lengths).decode(len(ids), *coded).tolist() == ids


class CountingTokenizer:
    def __init__(self, tokenizer):
        self.tokenizer, self.sent = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.sent += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_reach_the_library_joined():
    coder = Encoder(public_tokenizers.path("word_bpe_49k.json"), "word")
    coder.tokenizer = CountingTokenizer(coder.tokenizer)
    odd = ["\u1100\u1161", "\u01f0x", "stra\u00dfe", "\u03c3\u03b1\u03c2", "\u0e01\u0e33", "e\u0301a", "\u02b0", "\U0001e900", "x", "\u4e2d\u6587"]
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "qrstuvwxyz" for c in "klmnopqrst"] + odd
    got = coder.encode([" ".join(words)])[0]
    assert coder.tokenizer.sent < 100
    assert got == b"".join(coder.whole(w) for w in words)


@pytest.mark.parametrize("top", [0, 65535, 65536, 2**32 - 1])
def test_plain_ids_take_the_width_they_need(top):
    ids = np.array([3, top, 0], dtype="<u4")
    held = packed(ids.tobytes())
    assert len(held) == (6 if top < 65536 else 12)
    assert unpacked(held, 3).tolist() == ids.tolist()
