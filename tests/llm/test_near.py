import random
import re

import pytest

from motifloom.llm import near


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, threshold=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, size))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and 100 * len(a & b) >= threshold * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed, groups=12, biggest=70):
    """Groups of copies with a few words changed, passages shared by unlike texts, very common pairs."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60, 120, 300]))]
        for _ in range(biggest if g == 0 else rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 40, 80]))]
        texts.append(" ".join(own + passage))
    texts += ["", None, "one", "ONE", "two words", "a b c d", "a b c d e", " \n ", "the of the of the of"] + ["same text here again"] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,k,few,pivots", [(2, 64, 8, 16), (5, 16, 2, 1), (2, 1 << 40, 1, 1)])
def test_components_equal_brute_force(spark, size, k, few, pivots):
    rows = corpus(size)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component int").repartition(5)
    got = {r["id"]: r for r in near.near_components(docs, near.Settings(words=size, k=k, few=few, pivots=pivots, chunk=7)).collect()}
    want = brute(rows, size)
    assert {i: r["component"] for i, r in got.items()} == want
    assert all(got[i]["n"] == len(shingles(t, size)) for i, t in rows)


def test_without_broadcasts(spark):
    rows = corpus(7, 5, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = near.Settings(words=2, broadcast_bytes=0)
    got = {r["id"]: r["component"] for r in near.near_components(docs, s).collect()}
    assert got == brute(rows, 2)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "some words that make up a text of their own kind"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text + " more"), (None, "alone among all these rows")], "doc_id long, text string")
    got = sorted((str(r["id"]), str(r["component"])) for r in near.near_components(docs, near.Settings(words=2)).collect())
    assert got == [("3", "3"), ("5", "3"), ("5", "3"), ("None", "3"), ("None", "None")]
    assert near.near_components(docs.where("false")).count() == 0
    only = near.drop_near_duplicates(docs.withColumnRenamed("text", "gone_").selectExpr("doc_id", "gone_ as text", "1 as gone_"), near.Settings(words=2))
    assert only.columns == ["doc_id", "text", "gone_"] and sorted(str(r["doc_id"]) for r in only.collect()) == ["3", "None", "None"]


def test_long_chains_of_links(spark):
    words = [f"x{i}" for i in range(260)]
    rows = [(1000 - i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in near.near_components(docs, near.Settings(words=2)).collect()}
    assert got == brute(rows, 2) and len(set(got.values())) < 5


def test_rows_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    like, other, third = text + " more", " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(5, text, "a"), (5, text, "b"), (None, text, "c"), (7, like, "d"), (None, other, "e"), (None, other, "f"), (9, third, "g"), (9, third + " z", "h"), (5, "q " + other, "i"), (None, None, "j"), (None, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)
    got = near.drop_near_duplicates(docs, near.Settings(words=2), by_row=True)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["name"]) for r in got.collect()]
    assert sorted(i for i, n in kept if n in "gh") == [9] and sorted(i for i, n in kept if n in "abcd") == [5]
    assert [n for _, n in kept if n in "efi"] == ["i"] and sorted(n for _, n in kept if n in "jk") == ["j", "k"] and len(kept) == 5
