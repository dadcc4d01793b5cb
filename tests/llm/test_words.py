import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import blob
from motifloom.llm import words as W


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x0c\r日 ", max_size=30)), max_size=8), st.integers(1, 40))
def test_blocks_find_the_words(texts, size):
    seen = {}
    got = []
    for b in W.blocks(pa.array(texts, pa.string()), block_bytes=size):
        h = b.hashes()
        for i in range(b.rows):
            own = [bytes(b.raw[s:e]).decode() for s, e in zip(b.start[b.bounds[i] : b.bounds[i + 1]], b.end[b.bounds[i] : b.bounds[i + 1]])]
            got.append(own)
            for word, x in zip(own, h[b.bounds[i] : b.bounds[i + 1]]):
                assert seen.setdefault(word, x) == x
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_slices_of_a_column():
    column = pa.array(["a b", None, "c", "d e f"])[1:]
    assert [n for b in W.blocks(column, block_bytes=1) for n in np.diff(b.bounds)] == [0, 1, 3]
    assert list(W.blocks(pa.array([], pa.string()))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.booleans(), st.lists(st.integers(-(2**62), 2**62), max_size=9))
def test_blobs_come_back(values, rising, signed):
    a = np.array(sorted(values) if rising else values, np.uint64)
    b, c = np.array(signed, np.int64), np.array(signed, np.float64)
    for x, y in zip((a, b, c), blob.unpack(blob.pack(a, b, c)), strict=True):
        assert x.dtype == y.dtype and (x == y).all()


def test_sums():
    keys, counts = W.summed(np.array([3, 1, 3], np.uint64))
    assert keys.tolist() == [1, 3] and counts.tolist() == [1, 2]
    keys, counts = W.summed(np.array([3, 1, 3], np.uint64), np.array([5, 6, 7]))
    assert counts.tolist() == [6, 12]
