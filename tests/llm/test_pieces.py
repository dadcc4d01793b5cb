import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
import sentencepiece
from motifloom.llm import pieces
from motifloom.llm import words as W

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["Hello  world", "", " ", "\n\n a\tb ", "naïve straße 日本語 😀", "▁ literal ▁▁x", "a" * 300, "ab" * 200 + " é" * 90 + " " * 40, "<s> </s> <unk> <0x0A>", "x　y", None]


def block(texts, rate, seed=0):
    p = pieces.load(PATH)
    (b,) = W.blocks(pa.array(texts, pa.string()), block_bytes=1 << 40)
    ids, counts, same = pieces.encode_block(p, b.raw, b.offsets, W.mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed)), rate)
    at = np.r_[0, np.cumsum(counts)]
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], same


def test_without_dropout_equals_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got, same = block(TEXTS, 0.0)
    assert same.all()
    for t, ids in zip(TEXTS, got):
        if t is not None and "▁" not in t:
            assert ids == model.encode(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_any_text_comes_back(texts, rate):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert block(texts, rate)[1].all()


def test_segmentations_vary_by_seed_and_document_only():
    texts = ["international straightforwardness"] * 30
    one, again, other = block(texts, 0.2)[0], block(texts, 0.2)[0], block(texts, 0.2, 99)[0]
    assert one == again and one != other
    assert len({tuple(x) for x in one}) > 5
    plain = block(texts[:1], 0.0)[0][0]
    assert all(len(x) >= len(plain) for x in one)
    assert len(block(["abc def"], 1.0)[0][0]) == len("abc def") + 1


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_matrix_and_agenda_agree(rate):
    p = pieces.load(PATH)
    least = int(rate * 2**64)
    for i, word in enumerate(["internationalisation", "straßenbahn", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaa", " " * 17] * 8):
        points = np.array([ord(c) for c in " " + word], np.uint32)
        salt = W.mix(np.array([i], np.uint64))
        ids, _ = pieces._encode_units(p, points, np.array([0, len(points)]), salt, least)
        place = np.minimum(np.searchsorted(p.points, points), len(p.points) - 1)
        symbols = np.where(p.points[place] == points, p.point_ids[place], p.other)
        long, _ = pieces._merge_long(p, symbols, int(salt[0]), least)
        assert p.other not in long and ids.tolist() == long


def test_table_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (0, "Hello  world", 0)], "doc_id long, text string, ids int")
    coded = pieces.encode(docs, PATH, rate=0.3, seed=5)
    assert coded.where("not round_trip").count() == 0
    back = pieces.decode(coded, PATH).collect()
    want = {i: t for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert len(back) == len(TEXTS) + 2 and all(r["text"] == want[r["doc_id"]] for r in back)
    assert next(r for r in back if r["text"] is None)["ids"] is None
    assert pieces.encode(docs.where("false"), PATH).count() == 0


def test_a_text_of_another_size_hides_no_wrong_byte():
    block = lambda *texts: (np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    (out, n), (decoded, sizes) = block(b" abc", b" de", b"", b" fgh", b" i"), block(b" abX", b" d", b"", b" fgh", b" j")
    assert pieces._same(out, np.r_[0, np.cumsum(n)], decoded, sizes).tolist() == [False, False, True, True, False]
