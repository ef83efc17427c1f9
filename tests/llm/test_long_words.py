"""Words of any length: the same ids as without a table, tables bounded in bytes."""

import random

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import packing, piece_codec

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFÉéß日本語🙂ñ0123456789.,#\x07�"


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def random_word(rng, n, letters=LETTERS):
    return "".join(rng.choices(letters, k=n))


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 16])
def test_long_runs_by_the_search_of_short_ones(vocabulary, window):
    rng = random.Random(window)
    words = [random_word(rng, rng.randrange(1, 300)) for _ in range(60)] + ["a" * 500, "ab" * 200, "日" * 200, "\x01" * 150]
    for w in words:
        assert vocabulary._long_run(w.encode(), window) == next(vocabulary._search([w.encode()]))


def test_a_million_letters_in_one_word(vocabulary):
    word = random_word(random.Random(5), 1_000_000, LETTERS[:26])
    (ids,) = piece_codec.Encoder(vocabulary).encode([word])
    assert vocabulary.decode(np.frombuffer(ids, "<u4")) == word


def test_tables_of_pieces_hold_few_bytes_and_no_long_word(vocabulary):
    rng = random.Random(6)
    small, plain = piece_codec.Encoder(vocabulary, 20_000, 30), piece_codec.Encoder(vocabulary)
    for _ in range(30):
        texts = [" ".join(random_word(rng, rng.randrange(1, 60)) for _ in range(20)) for _ in range(3)]
        assert small.encode(texts) == plain.encode(texts)
        assert all(len(w) <= 30 for w in small.ids)
        assert sum(len(w) + len(i) for w, i in small.ids.items()) <= small.ids_bytes <= 20_000 + 60 * 500


def test_tables_of_words_hold_few_bytes_and_no_long_word():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    small = packing.WordCache(path, 20_000, 30)
    for _ in range(30):
        texts = [" ".join(random_word(rng, rng.randrange(1, 60)) for _ in range(20)) for _ in range(3)]
        want = [np.array(small.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert list(small.encode(texts)) == want
        assert all(len(w) <= 30 for w in [*small.ids, *small.parts])
        assert small.ids_bytes <= 20_000 + 60 * 1000 and small.parts_bytes <= 20_000 + 60 * 1000
