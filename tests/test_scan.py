import math
from itertools import product

import numpy as np
import pytest

from motifloom.functions.dna import CODE_OF, TWO_ALLELES, reverse_complement
from motifloom.operators import background as B
from motifloom.operators import motifs as M
from motifloom.operators import scan as S
from motifloom.operators import threshold as T
from motifloom.plans import inputs as I
from motifloom.plans.scan_queries import weights
from pyspark.sql import functions as F


def codes(text):
    return CODE_OF[np.frombuffer(text.encode(), np.uint8)]


def brute(seq, w, cutoff):
    out = []
    for name, m in w.items():
        for strand, x in (("+", m), ("-", m[::-1, ::-1])):
            for i in range(len(seq) - x.shape[1] + 1):
                window = seq[i : i + x.shape[1]]
                if set(window) <= set("ACGT"):
                    score = sum(x["ACGT".index(b), j] for j, b in enumerate(window))
                    if score >= cutoff:
                        out.append((name, i + 1, strand, round(float(score), 6)))
    return sorted(out)


def test_scan_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGTN"), 200, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for _ in range(5)] + ["", "AC", "acgtACGT" * 4]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "seq_id string, seq string")
    w = weights()
    want = sorted((str(i), *h) for i, t in enumerate(texts) for h in brute(t.upper(), w, 3.0))
    for table in (rows, S.chunked(rows.where("seq is not null"), 37, 5)):
        got = S.scan(table, w, T.cutoffs(w, "absolute", 3.0)).collect()
        assert sorted((r["seq"], r["motif"], r["begin"], r["strand"], round(r["score"], 6)) for r in got) == want
    assert all(r["end"] - r["begin"] + 1 == w[r["motif"]].shape[1] for r in got)


def test_strands_mirror(spark):
    seq = "ACGGTTACGCATGCAAGT"
    rows = spark.createDataFrame([("a", seq)], "seq_id string, seq string")
    other = rows.select("seq_id", reverse_complement(F.col("seq")).alias("seq"))
    w = weights()
    cut = T.cutoffs(w, "absolute", 0.0)
    n = len(seq)
    one = {(r["motif"], r["begin"], r["strand"], round(r["score"], 9)) for r in S.scan(rows, w, cut).collect()}
    two = {(r["motif"], n - r["end"] + 1, "-" if r["strand"] == "+" else "+", round(r["score"], 9)) for r in S.scan(other, w, cut).collect()}
    assert one == two and one


@pytest.mark.parametrize("text", ["ACRGTTYCA", "RRRRRRRRRR", "ACGSWKTTA"])
def test_two_allele_codes_enumerate_genotypes(text):
    w = {"M": weights()["M1"]}
    width = 4
    got = {(strand, at): (score, low, snps) for _, strand, at, score, low, snps in S.scan_codes(codes(text), w, {"M": 2.0})}
    for strand, x in (("+", w["M"]), ("-", w["M"][::-1, ::-1])):
        for at in range(len(text) - width + 1):
            window = text[at : at + width]
            options = [TWO_ALLELES.get(b, b) for b in window]
            scores = {g: sum(x["ACGT".index(b), j] for j, b in enumerate(g)) for g in product(*options)}
            good = {g: s for g, s in scores.items() if s >= 2.0}
            assert ((strand, at) in got) == bool(good)
            if good:
                score, low, snps = got[strand, at]
                assert math.isclose(score, max(good.values())) and math.isclose(low, min(good.values()))
                for s in snps:
                    seen = {g[s["offset"] - 1] for g in good}
                    assert s["allele"] == (seen.pop() if len(seen) == 1 else "N")
                    pair = TWO_ALLELES[s["ambig"]]
                    assert math.isclose(s["score_diff"], x["ACGT".index(pair[0]), s["offset"] - 1] - x["ACGT".index(pair[1]), s["offset"] - 1])


def test_too_many_codes_have_no_hit():
    w = {"M": np.ones((4, 9))}
    assert list(S.scan_codes(codes("R" * 9), w, {"M": 0.0})) == []
    assert len(list(S.scan_codes(codes("R" * 7 + "AC"), w, {"M": 0.0}))) == 2


def test_markov_background_by_hand():
    counts = np.arange(1, 65)
    seq = "ACGTTGCA"
    w = {"M": np.log2(np.array([[0.5, 0.1], [0.2, 0.4], [0.2, 0.4], [0.1, 0.1]]))}
    tables = B.next_base_tables(counts)
    number = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    lp = [tables[min(i, 2)][number(seq[max(0, i - 2) : i + 1])] for i in range(len(seq))]
    got = {(s, at): score for _, s, at, score, _, _ in S.scan_codes(codes(seq), w, {"M": -100.0}, counts)}
    for at in range(len(seq) - 1):
        want = w["M"]["ACGT".index(seq[at]), 0] + w["M"]["ACGT".index(seq[at + 1]), 1] - lp[at] - lp[at + 1]
        assert math.isclose(got["+", at], want)
    grams = {"".join(g): int(counts[number("".join(g))]) for g in product("ACGT", repeat=3)}
    assert math.isclose(lp[4], math.log2(grams["GTT"] + 0.25) - math.log2(sum(grams["GT" + b] for b in "ACGT") + 1))


def test_ambiguous_window_with_background_is_best_genotype():
    counts = np.arange(1, 65)
    w = {"M": np.log2(np.array([[0.5, 0.1], [0.2, 0.4], [0.2, 0.4], [0.1, 0.1]]))}
    score = lambda text: {(s, at): x for _, s, at, x, _, _ in S.scan_codes(codes(text), w, {"M": -100.0}, counts)}
    both = score("ACRT")
    assert math.isclose(both["+", 1], max(score("ACAT")["+", 1], score("ACGT")["+", 1]))


def test_p_value_cutoff_bounds_the_tail():
    for name, w in weights().items():
        scores = sorted((sum(w[b, j] for j, b in enumerate(g)) for g in product(range(4), repeat=w.shape[1])), reverse=True)
        for p in (0.5, 0.05, 0.004):
            cut = T.p_value_cutoff(w, p)
            step = 0.51 * w.shape[1] * (w.max() - w.min()) / T.STEPS
            assert sum(s >= cut + step for s in scores) / len(scores) <= p + 1e-12, name
            assert sum(s >= cut - 3 * step for s in scores) >= 1 or cut > scores[0]
    assert T.p_value_cutoff(weights()["M1"], 1.0) == float("inf")


def test_sequences_above_limit():
    w = weights()["M2"]
    want = {"".join(g) for g in product("ACGT", repeat=w.shape[1]) if sum(w["ACGT".index(b), j] for j, b in enumerate(g)) >= 4.0}
    got = T.sequences_above(w, 4.0)
    assert {s for s, _ in got} == want and len(got) == len(want)
    assert T.sequences_above(w, 100.0) == []


def test_relative_cutoff_and_unknown_kind():
    w = weights()
    assert math.isclose(T.cutoffs(w, "relative", 0.1)["M1"], math.log2(0.1) + w["M1"].max(axis=0).sum())
    with pytest.raises(ValueError):
        T.cutoffs(w, "other", 1)


def test_background_round_trips(spark):
    seqs = spark.createDataFrame([("a", "ACGTNacgtt"), ("b", "GG")], "seq_id string, seq string")
    grams = B.gram_counts(seqs, 1)
    vector = B.gram_vector(grams, 1)
    assert vector.sum() == 3 + 4 + 1 and vector[1] == 2  # AC
    assert (B.load_background(B.save_background(vector)) == vector).all()
    again = B.grams_of_vector(spark, vector).where("n > 0")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, grams.collect()))
    with pytest.raises(ValueError):
        B.grams_of_vector(spark, [1] * 7)
    freq = {r["base"]: r["n"] for r in B.base_frequencies(seqs).collect()}
    assert freq == {"A": 2, "C": 2, "G": 4, "T": 3}
    p = {r["gram"]: r["p"] for r in B.gram_probability(grams).collect()}
    assert math.isclose(p["TT"], 1.0)


def test_motif_exports(spark):
    motifs = I.motifs(spark)
    text = {r["motif"]: r["text"] for r in M.exported(motifs, "ahab").collect()}["M1"]
    assert text.startswith(">M1 Matrix\t4\n10\t0\t1\t0\n") and text.endswith("\n<")
    sites = [r["seq"] for r in M.example_sites(motifs).where("motif = 'M1'").collect()]
    assert len(sites) == 11 and sum(s[0] == "A" for s in sites) == 10
    summary = {r["motif"]: r for r in M.summary(M.derived(motifs)).collect()}
    w = weights()
    assert all(math.isclose(summary[m]["max_score"], w[m].max(axis=0).sum()) and summary[m]["width"] == w[m].shape[1] for m in w)
    back = M.reverse_complement(M.reverse_complement(motifs))
    assert sorted(map(tuple, back.select(*motifs.columns).collect())) == sorted(map(tuple, motifs.collect()))
