"""The chain queries on all sequences of a small events table, against brute force and group by group."""

import datetime as dt
import math

import numpy as np
import pytest

from motifloom.functions.penalty import Weights
from motifloom.operators import chain, merge, tree
from motifloom.plans import chain_queries as Q, inputs as I
from motifloom.sources.trees import parse_newick
from test_chain import brute_best

SEQUENCES = 6


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    start, kinds = dt.datetime(2024, 1, 1), sorted(I.WIDTHS)
    rows = []
    for user in range(SEQUENCES):
        for _ in range(16):
            at = start + dt.timedelta(minutes=int(rng.integers(0, 600)))
            rows.append((len(rows), at, user, str(rng.choice(kinds)), float(rng.uniform(100, 400)), "{}"))
    path = str(tmp_path_factory.mktemp("chains"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def sites(spark, sf_dir):
    return I.sites(spark, sf_dir).toPandas()


def pairs(sites):
    """The number, sequences, columns of all modules of every pair in a row."""
    for x in range(SEQUENCES - 1):
        names = [str(x), str(x + 1)]
        for rank, own in chain.aligned_frame(sites[sites.seq.isin(names)], names, 3, Weights()).groupby("module"):
            yield x * 10 + rank, names, own


def test_every_pair_has_its_terms(spark, sf_dir, sites):
    terms = Q.score_terms(spark, sf_dir).toPandas()
    assert not terms.off.any()
    best = {x: terms[terms.module == x * 10 + 1].total.sum() for x in range(SEQUENCES - 1)}
    for x, got in best.items():
        names = [str(x), str(x + 1)]
        assert math.isclose(got, brute_best(sites[sites.seq.isin(names)], names, Weights())[0], abs_tol=1e-6)
    assert sorted(zip(terms.module, terms.col)) == sorted((m, c) for m, _, own in pairs(sites) for c in own.col.unique())


def test_every_pair_is_written(spark, sf_dir, sites):
    want = list(pairs(sites))
    lines = [r["value"].split("\t") for r in Q.module_gff(spark, sf_dir).collect()]
    assert sorted(x[0] for x in lines if len(x) == 2) == [f"#{i}" for i in range(SEQUENCES)]
    assert sorted(x[-1] for x in lines if x[2:3] == ["CisModule"]) == sorted(f"CM {m}" for m, _, _ in want for _ in "xy")
    assert sum(x[-2].startswith("COL ") for x in lines if len(x) > 2) == sum(len(own) for _, _, own in want)
    anchors = sorted((r["module"], r["col"], *r["value"].split("\t")[:4]) for r in Q.module_anchors(spark, sf_dir).collect())
    begin = lambda own, col, s: str(own[(own.col == col) & (own.seq == s)].begin.iloc[0])
    assert anchors == sorted((m, col, *names, *(begin(own, col, s) for s in names)) for m, names, own in want for col in own.col.unique())
    assert sorted(r["module"] for r in Q.module_text(spark, sf_dir).collect()) == sorted(m for m, _, _ in want)


def test_every_pair_is_compared_with_every_triple(spark, sf_dir, sites):
    met = set()
    for x in range(SEQUENCES - 2):
        names = [str(x + i) for i in range(3)]
        for _, own in chain.aligned_frame(sites[sites.seq.isin(names)], names, 3, Weights()).groupby(["module", "col"]):
            spots = sorted(zip(own.seq, own.begin, own.end))
            met |= {(a, b) for a in spots for b in spots}
    got = Q.pairwise_base(spark, sf_dir).toPandas()
    assert len(got) == sum(len(own) for _, _, own in pairs(sites))
    for _, own in got.groupby(["module", "col"]):
        a, b = sorted(zip(own.seq, own.begin, own.end))
        assert own.used.tolist() == [(a, b) in met] * 2
    assert got.used.any()


def test_near_pairs_of_every_triple(spark, sf_dir, sites):
    got = Q.align_near_pairs(spark, sf_dir).toPandas()
    table = spark.createDataFrame(sites)
    assert set(got.group) == {str(x) for x in range(SEQUENCES - 2)}
    for x in (0, SEQUENCES - 3):
        names = [str(x + i) for i in range(3)]
        spans = [(r.seq, int(r.begin), int(r.end)) for _, _, own in pairs(sites) if set(own.seq) == set(names[:2]) for r in own.groupby(["module", "seq"]).agg(begin=("begin", "min"), end=("end", "max")).reset_index().itertuples()]
        spans.append((names[2], 0, 10**6))
        want = chain.align_near_pairs(table, spark.createDataFrame(spans, "seq string, begin int, end int"), names).toPandas()
        own = got[got.group == str(x)]
        key = lambda d: sorted(zip(d.col, d.seq, d.begin, d.end, d.motif))
        assert key(own) == key(want) and math.isclose(own.module_score.iloc[0], want.module_score.iloc[0])


@pytest.mark.parametrize("method", ["pairs", "representative"])
def test_every_five_in_a_row_have_a_tree(spark, sf_dir, sites, method):
    got = getattr(Q, f"align_tree_{method}")(spark, sf_dir).toPandas()
    assert set(got.group) == {str(x) for x in range(SEQUENCES - 4)} and set(got.seq) == {str(x) for x in range(SEQUENCES)}
    names = {str(x + 1) for x in range(5)}
    root = parse_newick("(((1,2),3),(4,5));", names)
    want = tree.align_tree_root(spark, spark.createDataFrame(sites[sites.seq.isin(names)]), root, 3, method=method).toPandas()
    scores = lambda d: d.groupby("module").module_score.first().round(6).tolist()
    own = got[got.group == "1"]
    assert scores(own) == scores(want) and len(own) == len(want)


def test_search_values_weights_on_all_pairs(spark, sf_dir, monkeypatch):
    from motifloom.operators import sites as S, stats

    own = I.sites(spark, sf_dir)
    w = Weights(1.5, 0.7, 0.4, 1.2)
    total = []
    for table in (own.toPandas(), S.randomised(own, 3).toPandas()):
        each = [brute_best(table[table.seq.isin(names)], names, w)[0] for names in ([str(x), str(x + 1)] for x in range(SEQUENCES - 1))]
        total.append(sum(each))
    value = Q.pair_contrast(own, Q._groups(spark, sf_dir, 2))
    assert math.isclose(value(w), total[0] / (total[1] + 1), rel_tol=1e-9)
    asked = []
    monkeypatch.setattr(stats, "climb", lambda *a, **how: asked.append(how) or (w, 1.0))
    assert Q.parameter_search(spark, sf_dir).count() == 1 and asked == [{}]  # the operator's own rounds


def places(sites):
    """The sites of every pairwise module of every pair, by its number."""
    return {m: {(r.seq, r.begin, r.end, r.motif, r.strand) for r in own.itertuples()} for m, _, own in pairs(sites)}


def test_overlaps_of_all_pairwise_modules(spark, sf_dir, sites, monkeypatch):
    monkeypatch.setattr(chain, "islands", None)  # no window over all cells, and no group an island
    own = places(sites)
    want = {}
    for a in own:
        for b in own:
            for seq, *_ in own[a] & own[b] if a < b else ():
                want[a, b, seq] = want.get((a, b, seq), 0) + 1
    got = {(r["a"], r["b"], r["seq"]): r["shared"] for r in Q.module_overlaps(spark, sf_dir).collect()}
    assert want and got == want


def test_contained_of_all_pairwise_modules(spark, sf_dir, sites, monkeypatch):
    monkeypatch.setattr(chain, "islands", None)
    own = places(sites)
    on = lambda m: {s[0] for s in own[m]}
    want = {(a, b) for a in own for b in own if a != b and own[a] & own[b] and {s for s in own[a] if s[0] in on(b)} <= own[b]}
    got = {(r["a"], r["b"]) for r in Q.contained_modules(spark, sf_dir).collect()}
    assert want and got == want


def test_merged_modules_of_all_pairs(spark, sf_dir, sites, monkeypatch):
    monkeypatch.setattr(chain, "islands", None)
    own = places(sites)
    got = Q.merge_modules(spark, sf_dir).toPandas()
    met = {b for a in own for b in own if a != b and own[a] & own[b]}
    for m in own.keys() - met:
        alone = got[got.component == m]
        assert {(r.seq, r.begin, r.end, r.motif, r.strand) for r in alone.itertuples()} == own[m] and set(alone.pairs) == {1} and set(alone.modules) == {1}
    spots = {s for m in own for s in own[m]}
    assert {(r.seq, r.begin, r.end, r.motif, r.strand) for r in got.itertuples()} <= spots and got.modules.max() > 1
    best = max(own, key=lambda m: scores(sites)[m])
    assert own[best] <= {(r.seq, r.begin, r.end, r.motif, r.strand) for r in got.itertuples()}


def scores(sites):
    return {m: own.module_score.iloc[0] for m, _, own in pairs(sites)}


@pytest.mark.parametrize("name", ["contained_modules", "module_overlaps"])
def test_pairs_are_aligned_once_for_both_sequences(spark, sf_dir, monkeypatch, name):
    rows, aligned, seen = Q.align_pairs(spark, sf_dir).count(), Q.align_pairs, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(Q, "align_pairs", lambda *a: (found := aligned(*a)).mapInArrow(counted, found.schema))
    assert Q.QUERIES[name](spark, sf_dir).count() and seen.value == rows > 0


def test_contained_counts_all_sequences_in_common(spark):
    of = {1: "s10 s20", 2: "s10 s20 s30 t10", 3: "s10 s20 t50", 4: "s10 u10", 5: "u70"}  # 1 in 2 and 3; 2 and 3 differ on t; 4 shares s with the first three; 5 meets none
    rows = [(m, x[0], int(x[1:]), int(x[1:]) + 5, "p", "+") for m, own in of.items() for x in own.split()]
    sites = spark.createDataFrame(rows, "module long, seq string, begin int, end int, motif string, strand string")
    assert {tuple(r) for r in merge.contained(sites).collect()} == {(1, 2), (1, 3), (3, 1), (4, 1), (4, 2), (4, 3)}
