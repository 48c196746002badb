"""Packing against the tokenizer on whole texts: every id in one piece, every sequence gapless."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.packing import cut_lengths, pack, token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=2048):
    """Share of padding; texts is a list of (key, text)."""
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = defaultdict(int)
    for i, _ in texts:
        copies[i] += 1
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start)[:: copies[i]]:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / (capacity * max(len(sequences), 1))


def test_query_packs_everything(spark, sample):
    assert check(CASES["op6_packing"].run(spark, BASE).collect(), list(sample.items())) < 0.03


def test_odd_texts_and_repeated_rows(documents):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "z" * 30_000), (5, "same text"), (5, "same text"), (6, "<|endoftext|> a")]
    check(pack(documents(texts), PATH).collect(), texts)
    assert pack(documents({}), PATH).collect() == []


def test_ids_equal_the_tokenizer():
    rng = random.Random(0)
    signs = list("abcdefgABCXYZ\u0301 éèÀÉ'.,;!?%*$#&|\n\ṯ́ \x0b\x1c5９①Ⅷßİ<|>-_日本ſK÷×")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|>", "x <|startoftext|>'s", "dog's.don't.'s", "a.'s b", "H̱ ẖ", "Straße É.É,é!"]
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, token_bytes(PATH, texts)):
        assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_cuts_cover_every_length():
    for n in range(1, 5000):
        cut = cut_lengths(n, 2048, 128, 32)
        assert sum(cut) == n and max(cut) <= 2048 and len(cut) <= n // 2048 + 5
        waste = sum((2048 - 2048 // c * c) / (2048 // c) for c in cut)
        assert waste <= 45
