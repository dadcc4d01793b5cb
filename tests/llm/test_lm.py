import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from motifloom.llm import lm


def tokens(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3))


def brute(train):
    pairs, raw = Counter(), Counter()
    for t in train:
        ts = tokens(t)
        raw.update(ts)
        pairs.update(zip(["<s>", *ts], ts))
    before, context = Counter(), defaultdict(list)
    for (v, w), c in pairs.items():
        before[w] += 1
        context[v].append(c)
    dw, dp = discounts(before.values()), discounts(pairs.values())
    total = sum(before.values())
    off = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]
    gamma = sum(off(dw, c) for c in before.values()) / total if total else 1.0

    def p_word(w):
        return (max(before[w] - off(dw, before[w]), 0) / total if total else 0) + gamma / (len(raw) + 1)

    def p(v, w):
        if v not in context:
            return p_word(w)
        t = sum(context[v])
        c = pairs[v, w]
        return max(c - off(dp, c), 0) / t + sum(off(dp, x) for x in context[v]) / t * p_word(w)

    return p, p_word, raw


TEXTS = ["The cat sat on the mat", "the cat ate  the\tfish", "a dog sat on a cat and the cat sat", "", None, "Ünï cödé THE the the the", "a b c d e f g a b c a b a", "mat mat mat the\nthe", "zebra only here", "the cat sat on the mat"]


@pytest.mark.parametrize("shards", [1, 5])
def test_scores_equal_brute_force(spark, shards):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    p, p_word, raw = brute([t for i, t in rows if not out(i)])
    model = lm.train(docs.where(~lm.held_out("doc_id")), shards=shards)
    assert model.tokens == sum(raw.values()) and model.types == len(raw)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ts = tokens(t)
        want = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ts], ts))
        base = sum(math.log10((raw[w] + 1) / (model.tokens + len(raw) + 1)) for w in ts)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9, abs_tol=1e-12)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(ts), sum(raw[w] > 0 for w in ts))
    for v in ("the", "never seen", "<s>"):
        unknown = p(v, "?never?")
        assert math.isclose(sum(p(v, w) for w in raw) + unknown, 1.0)


def test_empty_tables_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "x y", 1), (1, None, 2)], "doc_id long, text string, score int")
    model = lm.train(docs.where("false"))
    got = lm.score(docs, model).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [3, 1] and [r["score"] for r in got] == [0.0, 0.0]
    assert lm.score(docs.where("false"), model).count() == 0
    full = lm.train(docs)
    assert full.tokens == 4 and lm.score(docs, full).count() == 2


def test_long_text_and_repeated_rows(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x" * 500_000)], "doc_id long, text string")
    model = lm.train(docs)
    got = lm.score(docs, model).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 300_001, 300_001]
