"""Hashes of words: what they are, and what a worker needs for them."""

import random
import tracemalloc

from tidewatch.llm.words import SIGNS, WHITE, Words


def test_words_of_a_large_piece_are_hashed_in_blocks():
    """2 MB of texts, as much as a worker gets at a time: each word has the hash that it has alone, also at the edges of
    blocks and where it is longer than one, and the numbers for each byte never stand for the whole piece at once."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abCdé") for _ in range(rng.randint(1, 12))) for _ in range(200)).encode() for _ in range(1300)]
    texts += [None, b"", b"x" * 200_000 + b" y", b" \n", b"z" * 65_536, b"last"]
    for cuts in (WHITE, SIGNS):
        Words([b"warm up"], cuts)
        tracemalloc.start()
        words = Words(texts, cuts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(words.data) > 2_000_000 and peak < 15 * len(words.data)
        for i in [*range(0, len(texts) - 6, 100), *range(len(texts) - 6, len(texts))]:
            alone = Words([texts[i]], cuts)
            assert words.hashes[words.first[i] : words.first[i + 1]].tolist() == alone.hashes.tolist()
        for k in rng.sample(range(len(words.hashes)), 300):
            assert words.hashes[k] == Words([words.text_of(k)], cuts).hashes[0]
