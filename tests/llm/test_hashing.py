import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tuneforge.llm import hashing as H
from tuneforge.llm.common import blocks

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b\x1c .", max_size=12), max_size=8), st.booleans())
def test_words_and_hashes_of_blocks(texts, fold):
    column = pa.array([t.encode() for t in texts], pa.binary())
    seen = {}
    for i, j, buf, offsets in blocks(column, 16):
        starts, ends, rows = H.word_spans(buf, offsets)
        hashes = H.word_hashes(buf, starts, ends, fold)
        for r in range(j - i):
            own = slice(rows[r], rows[r + 1])
            words = [buf[a:b].tobytes() for a, b in zip(starts[own], ends[own])]
            assert words == WORD.findall(texts[i + r].encode())
            for word, h in zip(words, hashes[own].tolist()):
                assert seen.setdefault(word.lower() if fold else word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hash_of_a_word_does_not_depend_on_place_or_length_of_text():
    word = b"x" * 300_000
    for before in (b"", b"ab ", b"q " * 150_000):
        buf = np.frombuffer(before + word + b" tail", np.uint8)
        starts, ends, _ = H.word_spans(buf, np.array([0, len(buf)]))
        hashes = H.word_hashes(buf, starts, ends, False)
        alone = np.frombuffer(word, np.uint8)
        assert hashes[len(before.split())] == H.word_hashes(alone, np.array([0]), np.array([len(word)]), False)[0]
        tail = np.frombuffer(b"tail", np.uint8)
        assert hashes[-1] == H.word_hashes(tail, np.array([0]), np.array([4]), False)[0]


def test_windows():
    words = np.arange(7, dtype=np.uint64)
    assert len(H.window_hashes(words, 8)) == 0
    grams = H.window_hashes(np.concatenate([words, words]), 5)
    assert grams[0] == grams[7] and len(np.unique(grams)) == 7
