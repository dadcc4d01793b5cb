import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from motifloom.llm import langid


def discounts(counts):
    return langid._discounts(*(sum(c == i for c in counts) for i in (1, 2, 3, 4)))


class Brute:
    """Interpolated modified Kneser-Ney over padded words, from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter()
        for t in texts:
            for w in words(t):
                s = " " + w + " "
                for i in range(1, len(s)):
                    for n in range(1, min(order, i + 1) + 1):
                        self.raw[s[i + 1 - n : i + 1]] += 1
        before = defaultdict(set)
        for g in self.raw:
            if len(g) > 1:
                before[g[1:]].add(g[0])
        self.c = {g: n if len(g) == order or len(g) > 1 and g[0] == " " else len(before[g]) for g, n in self.raw.items()}
        self.c = {g: n for g, n in self.c.items() if n}
        self.d = {n: discounts([c for g, c in self.c.items() if len(g) == n]) for n in range(1, order + 1)}
        self.follow = defaultdict(list)
        for g, c in self.c.items():
            self.follow[g[:-1]].append((g, c))

    def p(self, g, symbols):
        if not g:
            return 1 / (symbols + 1)
        off = lambda x: min(self.d[len(g)][min(self.c[x], 3) - 1], self.c[x])
        lower = self.p(g[1:], symbols)
        if g[:-1] not in self.follow:
            return lower
        total = sum(c for _, c in self.follow[g[:-1]])
        weight = sum(off(x) for x, _ in self.follow[g[:-1]]) / total
        return (self.c[g] - off(g) if g in self.c else 0) / total + weight * lower

    def bits(self, text, symbols):
        total = n = 0
        for w in words(text):
            s = " " + w + " "
            for i in range(1, len(s)):
                total -= math.log2(self.p(s[max(0, i + 1 - self.order) : i + 1], symbols))
                n += 1
        return total / n


def words(text):
    return "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split()


EN = ["the house is on the hill", "This thing that we thought of", "there is nothing in the other room", "with the weather they went", "that is the truth"]
DE = ["das haus ist auf dem hügel", "nicht alles was glänzt ist gold", "der schöne straßenname ist lang", "und die katze schläft auch", "ich weiß es nicht"]


def table(spark):
    rows = [(i, t, "en") for i, t in enumerate(EN * 3)] + [(50 + i, t, "de") for i, t in enumerate(DE * 3)]
    rows += [(100, "1234 !! ??", "en"), (101, None, "en"), (102, "", None), (103, "the thing nothing", None), (104, "schöne katze", "de"), (105, "Ж", "en"), (106, "x" * 50_000, "en")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")


def test_costs_equal_brute_force(spark):
    docs = spark.createDataFrame([(t, "en") for t in EN] + [(t, "de") for t in DE], "text string, lang string").repartition(3)
    model = langid.train(docs, order=3)
    both = {"en": Brute(EN, 3), "de": Brute(DE, 3)}
    symbols = len({g for m in both.values() for g in m.raw if len(g) == 1})
    assert model.symbols == symbols and model.languages == ("de", "en")
    found = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate([*EN, *DE, "unseen zebra ñ"])], "id long, text string"), model, ["id"]).collect()
    for r in found:
        t = [*EN, *DE, "unseen zebra ñ"][r["id"]]
        want = {x: m.bits(t, symbols) for x, m in both.items()}
        assert math.isclose(r["bits"], min(want.values()), rel_tol=1e-4)
        assert r["lang_pred"] == min(want, key=want.get)


def test_predictions(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in langid.op10_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count()
    assert all(got[i]["lang_pred"] == "en" for i in range(15)) and all(got[50 + i]["lang_pred"] == "de" for i in range(15))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[101]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] == "de" and got[105]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[106]["rejected"] or got[106]["held_out"] is False


def test_rejects_about_the_share_asked_for(spark, tmp_path):
    rng = random.Random(5)
    names = {"aa": "abcdefgh", "bb": "hijklmno"}
    known = {x: ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(60)] for x, letters in names.items()}
    rows = [(i, " ".join(rng.choices(known[x], k=30)), x) for i, x in ((i, rng.choice(["aa", "bb"])) for i in range(1200))]
    rows += [(2000 + i, " ".join("".join(rng.choices("pqrstuvwxyz", k=5)) for _ in range(30)), None) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in langid.op10_language_id(spark, str(tmp_path), reject=0.1).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows if i < 2000)
    held = [got[i]["rejected"] for i in range(1200) if got[i]["held_out"]]
    assert 0.02 < sum(held) / len(held) < 0.25
    assert all(got[2000 + i]["rejected"] for i in range(20))
    calibrating = {rows[i][1] for i in range(1200) if got[i]["calibrates"]}
    assert 60 < len(calibrating) < 140 and not any(got[i]["calibrates"] for i in got if got[i]["held_out"])


def test_calibration_leaves_every_language_some_text(spark):
    docs = spark.createDataFrame([(f"word{i}", "rare" if i % 7 else "other") for i in range(40)] + [("x", None), (None, "rare")], "text string, lang string")
    tenth = docs.where("pmod(xxhash64(text), 10) = 0 and lang = 'rare' and text is not null")
    assert tenth.count() and tenth.where(langid.calibrating(tenth)).count() == 0
    assert docs.where(langid.calibrating(docs) & F.col("lang").isNull()).count() == 0


def test_shards_give_the_same_predictions(spark, monkeypatch):
    docs = table(spark)
    one = langid.predict(docs, langid.train(docs), ["doc_id"]).orderBy("doc_id").collect()
    monkeypatch.setattr(langid, "_LEAST_ROWS_A_SHARD", 20)
    model = langid.train(docs)
    assert min(n for _, n in model.shards) > 1
    assert langid.predict(docs, model, ["doc_id"]).orderBy("doc_id").collect() == one


def test_clashing_names(spark):
    docs = table(spark).select("doc_id", "text", "lang", F.lit(1).alias("lang_pred"), F.lit("b").alias("bits"), "score", F.lit(2).alias("a.b"))
    got = langid.predict(docs, langid.train(docs), docs.columns)
    assert got.columns == [*docs.columns, "lang_pred_", "score_", "bits_"]
    assert {r["doc_id"]: r["lang_pred_"] for r in got.collect()}[0] == "en"


def test_nothing_to_learn_from(spark):
    docs = table(spark)
    assert langid.train(docs.where("false")) is None
    assert langid.train(docs.where("lang is null")) is None
    got = langid.predict(docs, None, ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert langid.predict(docs.where("false"), langid.train(docs), ["doc_id"]).count() == 0
