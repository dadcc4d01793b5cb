import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from motifloom.functions.penalty import Weights, step_penalty, step_penalty_column
from motifloom.operators import chain, graph, merge, sites as S, stats, tree
from motifloom.sinks import gff, text
from motifloom.sources.trees import parse_newick
from pyspark.sql import functions as F

#: The smallest published case: three columns, the second without a gap before it.
SMALL = [
    ("H", "Irf-1", 2611, 2622, 9.8776, "+"), ("M", "Irf-1", 3107, 3118, 9.8776, "+"),
    ("H", "Broadc3", 2623, 2633, 9.60383, "+"), ("M", "Broadc3", 3119, 3129, 10.138, "+"),
    ("H", "hb", 2637, 2647, 13.4072, "-"), ("M", "hb", 3132, 3142, 12.9907, "-"),
]
SITE = "seq string, motif string, begin int, end int, score double, strand string"


def random_sites(seed, names="xyz", n=14, span=400):
    rng = np.random.default_rng(seed)
    rows = []
    for s in names:
        for _ in range(n):
            b = int(rng.integers(1, span))
            rows.append((s, str(rng.choice(["a", "b", "c"])), b, b + int(rng.integers(4, 9)), float(rng.uniform(1, 9)), str(rng.choice(["+", "-"]))))
    return pd.DataFrame(rows, columns=["seq", "motif", "begin", "end", "score", "strand"])


def brute_best(df, names, w, bonus="pairs", banned=frozenset()):
    """Best chain by recursion over all cells."""
    lists = [df[df.seq == s].sort_values(["begin", "end", "motif", "strand"]).reset_index(drop=True) for s in names]
    cells = [[]]
    for i, rows in enumerate(lists):
        cells = [c + [r] for c in cells for r in rows.itertuples() if not c or (c[0].motif, c[0].strand) == (r.motif, r.strand)]
    key = lambda c: tuple((r.begin, r.end, r.motif, r.strand, r.score) for r in c)
    cells = sorted((c for c in cells if key(c) not in banned), key=lambda c: [r.begin for r in c])
    d = len(names)
    factor = d * (d - 1) / 2 if bonus == "pairs" else d - 1
    best = {}
    for c in cells:
        base = w.lam * factor * sum(r.score for r in c)
        top, via = 0.0, None
        for p in cells:
            if key(p) in best and all(0 < b.begin - a.end < 1000 for a, b in zip(p, c, strict=True)):
                gaps = [b.begin - a.end - 1 for a, b in zip(p, c, strict=True)]
                worth = best[key(p)][0] - sum(float(step_penalty(x, y, w)) for x, y in combinations(gaps, 2))
                if worth > top:
                    top, via = worth, p
        best[key(c)] = (base + top, via)
    if not best:
        return 0.0, []
    k = max(best, key=lambda k: best[k][0])
    path, at = [k], best[k][1]
    while at is not None:
        path.append(key(at))
        at = best[key(at)][1]
    return best[k][0], path


def test_published_module(spark):
    df = spark.createDataFrame(SMALL, SITE)
    got = chain.align(df, ["H", "M"], 1).orderBy("col", "seq").collect()
    assert len(got) == 6
    deltas = [round(r["delta"], 2) for r in got[::2]]
    assert deltas == [39.51, 39.48, 51.27]
    assert abs(got[0]["module_score"] - 130.27) < 0.01


@pytest.mark.parametrize("names,bonus", [("xy", "pairs"), ("xyz", "pairs"), ("xyz", "chain")])
def test_chains_equal_brute_force(names, bonus):
    w = Weights(mu=0.05, nu=0.2)
    for seed in range(4):
        df = random_sites(seed, names, 10 if len(names) == 3 else 16)
        got = chain.aligned_frame(df, list(names), 3, w, bonus)
        banned = set()
        for module in (1, 2, 3):
            want, path = brute_best(df, names, w, bonus, banned)
            own = got[got.module == module]
            if own.empty:
                assert want == 0
                break
            assert math.isclose(own.module_score.iloc[0], want, rel_tol=1e-9)
            cells = [tuple((r.begin, r.end, r.motif, r.strand, r.weight) for r in g.itertuples()) for _, g in own.groupby("col")]
            banned |= set(cells)


def test_removal_never_raises_a_score_and_equals_solving_anew():
    w = Weights(mu=0.05)
    df = random_sites(9, "xy", 40, 3000)
    keys = sorted(set(zip(df.motif, df.strand)))
    lists = [chain._listed(df[df.seq == s], {k: i for i, k in enumerate(keys)}) for s in "xy"]
    cells = chain.cells_of(lists)
    chains = chain.chains_of(cells, w)
    last = np.inf
    while (got := chains.pop()) is not None:
        assert got[0] <= last + 1e-9
        last = got[0]
        fresh = chain.chains_of(cells, w)
        dead = ~chains.alive
        fresh.alive[dead] = False
        fresh.score[dead] = -np.inf
        for c in range(len(fresh.base)):
            if fresh.alive[c]:
                fresh._solve(c)
        assert np.allclose(fresh.score, chains.score)


def test_shift_of_coordinates_changes_nothing():
    df = random_sites(3, "xy")
    moved = df.assign(begin=df.begin + 5000, end=df.end + 5000)
    a, b = (chain.aligned_frame(x, ["x", "y"], 2, Weights()) for x in (df, moved))
    assert np.allclose(a.module_score, b.module_score) and (a.begin + 5000 == b.begin).all()


def test_gapped_columns_reach_at_least_the_full_ones():
    df = random_sites(5)
    full = chain.aligned_frame(df, list("xyz"), 1, Weights(), "chain")
    gapped = chain.aligned_frame(df, list("xyz"), 1, Weights(), "chain", gap_limit=1)
    assert gapped.module_score.max() >= full.module_score.max() - 1e-9


def test_islands_give_the_same_modules(spark):
    frames = []
    for k in range(3):
        df = random_sites(k, "xy", 12)
        frames.append(df.assign(begin=df.begin + 5000 * k, end=df.end + 5000 * k))
    df = pd.concat(frames)
    table = spark.createDataFrame(df)
    cells = S.cells(table.where("seq = 'x'"), table.where("seq = 'y'"))
    assert chain.islands(cells).select("island").distinct().count() >= 3
    got = chain.align_pairs(cells, 4).groupBy("rank").agg(F.max("score").alias("s")).orderBy("rank").collect()
    want = chain.aligned_frame(df, ["x", "y"], 4, Weights()).groupby("module").module_score.first()
    assert np.allclose([r["s"] for r in got], want.to_numpy())


def test_empty_and_single_sequences(spark):
    df = spark.createDataFrame(SMALL, SITE)
    assert chain.align(df, ["H", "nobody"], 3).count() == 0
    assert chain.align(df.where("false"), ["H", "M"], 3).count() == 0


def test_down_to_takes_one_below():
    df = random_sites(2, "xy", 20)
    every = chain.aligned_frame(df, ["x", "y"], 100, Weights()).groupby("module").module_score.first()
    bound = float(every.iloc[2]) - 1e-6
    got = chain.aligned_frame(df, ["x", "y"], 0, Weights(), down_to=bound).groupby("module").module_score.first()
    assert len(got) == (every > bound).sum() + 1 and got.iloc[-1] <= bound


def test_more_from_the_same_scores_shares_no_cell():
    got = chain.aligned_frame(random_sites(4, "xy", 25), ["x", "y"], 5, Weights(mu=0.05), keep_scores=True)
    cells = got.groupby(["module", "col"])[["begin", "end"]].apply(lambda g: tuple(map(tuple, g.to_numpy())))
    assert cells.is_unique


def test_steps_and_penalties_agree(spark):
    df = spark.createDataFrame(random_sites(1, "xy", 25, 2500))
    cells = S.cells(df.where("seq = 'x'"), df.where("seq = 'y'")).withColumn("id", F.monotonically_increasing_id())
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    rows = cells.collect()
    want = {(a["id"], b["id"]): float(step_penalty(b["begin_x"] - a["end_x"] - 1, b["begin_y"] - a["end_y"] - 1, Weights())) for a in rows for b in rows if 0 < b["begin_x"] - a["end_x"] < 1000 and 0 < b["begin_y"] - a["end_y"] < 1000}
    got = {(r["from_id"], r["to_id"]): r["penalty"] for r in S.steps(cells).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    zero = spark.range(1).select(step_penalty_column(F.lit(0), F.lit(0)).alias("p")).first()["p"]
    assert zero == 0.0 == float(step_penalty(0, 0, Weights()))


def test_tree_methods(spark):
    df = random_sites(7, "abc", 12, 300)
    table = spark.createDataFrame(df)
    root = parse_newick("((a:1,b:2):3,c);", {"a", "b", "c"})
    two = chain.aligned_frame(df, ["a", "b"], 1, Weights())
    for method in ("pairs", "general", "representative"):
        found = tree.align_tree(table, root, method, k=10)
        first = tree.node_alignments(found, root.children[0].number, 1).toPandas()
        if method != "general":
            assert math.isclose(first.module_score.iloc[0], two.module_score.iloc[0])
        top = tree.node_alignments(found, root.number, 3).toPandas()
        assert set(top.seq) == {"a", "b", "c"}
        assert (top.groupby("module").module_score.first().diff().dropna() <= 1e-9).all()
    single = found[root.number].where("module = 1 and col = 0").agg(F.sum("weight")).first()[0]
    del single
    with pytest.raises(ValueError):
        tree.node_alignments(found, 0)


def test_first_tree_column_counts_each_site_for_each_other_sequence():
    one = lambda n, b, w: tree.Columns([n], np.array([0]), np.array([[b]]), np.array([[b + 5]]), np.array([[w]]))
    parts = [one("dog", 1, 9.144311), one("horse", 9, 9.144311), one("cow", 4, 9.144311), one("mouse", 2, 9.144311), one("human", 7, 6.577964)]
    merged = parts[0]
    for p in parts[1:]:
        score, merged, _ = tree.aligned_columns(merged, p, 1, "pairs", Weights())[0]
    assert abs(score - 345.24) < 0.01


@pytest.mark.parametrize("bad", ["((a,b),", "(a,b,c);", "(a,b)x)", "(a,zz);"])
def test_bad_trees(bad):
    with pytest.raises((ValueError, IndexError)):
        parse_newick(bad, {"a", "b", "c"})


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_components_of_long_paths(spark, monkeypatch, order):
    ids = list(range(2000))
    if order == "descending":
        ids.reverse()
    elif order == "shuffled":
        np.random.default_rng(5).shuffle(ids)
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, own=graph.stored: (written.append(name), own(df, name))[1])
    got = graph.components(spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])], "a long, b long").coalesce(2)).collect()
    assert len(got) == 2000 and {r["component"] for r in got} == {0}
    assert written.count("edges") <= 10 and written.count("up") <= 40


def test_components_and_closure(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    closed = {tuple(r) for r in graph.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")).collect()}
    assert closed == {(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4)}
    assert graph.maximal_cliques({1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}) == [(1, 2, 3), (3, 4)]
    assert graph.dot(spark.createDataFrame([(1, 2)], "a long, b long")) == "graph g {\n  1 -- 2;\n}\n"
    crossed = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (1, "y", 9), (2, "y", 5), (3, "x", 20), (3, "y", 30)], "id long, seq string, begin int")
    assert [tuple(r) for r in graph.inconsistent_pairs(crossed).collect()] == [(1, 2)]


def _module(m, score, rows):
    return [(m, col, seq, motif, "+", b, b + 5, score) for col, motif, at in rows for seq, b in at]


def test_merging_pairwise_modules(spark):
    rows = (
        _module(1, 50.0, [(0, "p", [("a", 10), ("b", 110)]), (1, "q", [("a", 40), ("b", 140)])])
        + _module(2, 40.0, [(0, "p", [("b", 110), ("c", 210)]), (1, "r", [("b", 120), ("c", 222)]), (2, "q", [("b", 140), ("c", 240)])])
        + _module(3, 30.0, [(0, "q", [("a", 40), ("c", 205)]), (1, "p", [("a", 60), ("c", 210)])])
        + _module(9, 5.0, [(0, "z", [("d", 1), ("e", 2)])])
    )
    sites = spark.createDataFrame(rows, "module long, col int, seq string, motif string, strand string, begin int, end int, score double")
    modules = sites.groupBy("module").agg(F.first("score").alias("score"))
    links = {(r["a"], r["b"], r["seq"]): r["shared"] for r in merge.overlaps(sites).collect()}
    assert links == {(1, 2, "b"): 2, (1, 3, "a"): 1, (2, 3, "c"): 1}
    got = merge.merge_modules(sites, modules).toPandas()
    first = got[(got.component == 1) & (got.nth == 0)]
    assert first.score.iloc[0] == 90.0  # the third contradicts the order
    table = [(motif, dict(zip(g.seq, g.begin))) for (_, motif), g in first.groupby(["col", "motif"])]
    assert table == [("p", {"a": 10, "b": 110, "c": 210}), ("r", {"b": 120, "c": 222}), ("q", {"a": 40, "b": 140, "c": 240})]
    assert first[first.motif == "p"].pairs.iloc[0] == 2
    assert set(got.component) == {1, 9}
    inside = {tuple(r) for r in merge.contained(sites).collect()}
    assert (1, 2) in inside and (2, 1) not in inside
    assert merge.shared_sites(sites, 1, 2).count() == 2
    assert {r["seq"]: r["modules"] for r in merge.modules_a_sequence(sites).collect()}["a"] == 2
    texts = text.merged_texts(merge.merge_modules(sites, modules), 2).collect()
    assert any("p\t+\t2" in r["value"] and "r\t" not in r["value"] for r in texts)
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    other = spark.createDataFrame([(2, 3)], "a int, b int")
    third = spark.createDataFrame([(1, 3), (1, 4)], "a int, b int")
    assert [tuple(r) for r in merge.joined_pairs(pairs, other).collect()] == [(1, 3)]
    assert [tuple(r) for r in merge.species_triples(pairs, other, third).collect()] == [(1, 2, 3)]


def test_module_file_and_terms(spark):
    columns = chain.align(spark.createDataFrame(SMALL, SITE), ["H", "M"], 1)
    lines = [r["value"] for r in gff.module_lines(columns).orderBy("place").collect()]
    assert lines[0].startswith("### lambda=2.000000 mu=0.500000")
    assert lines[1] == "#H\t"
    assert lines[3] == 'H\tmalign\tCisModule\t2611\t2647\t130.27\t.\t.\t\tTarget "M";\tStart 3107;\tEnd 3142;\tStrand .;\tFrame .;\tCM 1'
    assert lines[5] == "H\tmalign\tIrf-1\t2611\t2622\t39.51\t+\t.\tCM 1\tMW 9.8776\tCOL 0\t"
    anchors = [r["value"].split("\t") for r in gff.anchor_lines(columns, "H", "M").orderBy("col").collect()]
    assert anchors[0][:5] == ["H", "M", "2611", "3107", "11"]
    terms = stats.score_terms(columns).orderBy("col").toPandas()
    assert not terms.off.any() and math.isclose(terms.total.sum(), columns.agg(F.max("module_score")).first()[0])
    letters = spark.createDataFrame([("H", "ACGT" * 800), ("M", "TGCA" * 800)], "seq_id string, seq string")
    shown = text.module_texts(columns, letters).first()["value"]
    assert "Sequence 1: H" in shown and "Irf-1" in shown
    used = text.pairwise_base(columns, columns).select("used").distinct().collect()
    assert [r["used"] for r in used] == [True]


def test_climb_improves():
    target = np.array([1.0, 2.0, 0.5, 1.5])
    value = lambda w: -float(np.abs(np.array([w.lam, w.mu, w.nu, w.xi]) - target).sum())
    w, got = stats.climb(value, rounds=200)
    assert got > value(Weights())


def many_pairs(count, n=14, letters=3000, seed=0):
    """Sites of sequences 0, 1, ... in several islands, some alike but for their weight."""
    rng = np.random.default_rng(seed)
    rows = [(str(s), "AB"[rng.integers(2)], int(b := rng.integers(0, letters)), int(b + 5), float(rng.integers(1, 5) * 100), "+-"[rng.integers(2)]) for s in range(count) for _ in range(n)]
    rows += [(*r[:4], r[4] + 50, r[5]) for r in rows[::9]]
    return pd.DataFrame(rows, columns=["seq", "motif", "begin", "end", "score", "strand"])


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_many_pairs_at_once_are_as_one_by_one(monkeypatch, most):
    monkeypatch.setattr(chain, "_ISLANDS", most)
    df = many_pairs(9)
    number = df.seq.astype(int).to_numpy()
    pair, nth = np.r_[number, number - 1], np.repeat([0, 1], len(df))
    label = (df.motif + df.strand).map({k: i for i, k in enumerate(["A+", "A-", "B+", "B-"])}).to_numpy()
    twice = lambda c: np.r_[df[c].to_numpy(), df[c].to_numpy()]
    keep = (pair >= 0) & (pair < 8)
    got = {}
    for own in chain.pair_cells(*(v[keep] for v in (pair, nth, np.r_[label, label], twice("begin"), twice("end"), twice("score")))):
        for c, rank, col, running, score in zip(*chain.best_of_pairs(own, 3, Weights())):
            got.setdefault((int(own.pair[c]), int(rank)), []).append((int(col), tuple(own.begin[c]), float(running), float(score)))
    want = {}
    for p in range(8):
        names = [str(p), str(p + 1)]
        for (m, col), rows in chain.aligned_frame(df[df.seq.isin(names)], names, 3, Weights()).groupby(["module", "col"]):
            rows = rows.set_index("seq").loc[names]
            want.setdefault((p, m), []).append((col, tuple(rows.begin), rows.cum_score.iloc[0], rows.module_score.iloc[0]))
    assert got.keys() == want.keys()
    assert [sorted(v[0][3] for k, v in got.items() if k[0] == p) for p in range(8)] == [sorted(v[0][3] for k, v in want.items() if k[0] == p) for p in range(8)]
    scores = [v[0][3] for v in want.values()]
    alone = [k for k in want if scores.count(want[k][0][3]) == 1]
    assert alone and all(got[k] == want[k] for k in alone)


def test_next_sequences_give_the_same_from_sites_and_cells(spark):
    df = many_pairs(7, seed=3)
    df = pd.concat([df, df.assign(seq="20"), df[df.seq == "0"].assign(seq="x")])  # without a next one, and without a number
    table = spark.createDataFrame(df).repartition(5)
    x, y = (table.where("seq != 'x'").withColumn("pair", F.col("seq").cast("long") - i) for i in (0, 1))
    side = lambda t, s: t.select("pair", "motif", "strand", *(F.col(c).alias(f"{n}_{s}") for c, n in (("seq", "seq"), ("begin", "begin"), ("end", "end"), ("score", "weight"))))
    cells = side(x, "x").join(side(y, "y"), ["pair", "motif", "strand"]).drop("pair")
    key = ["seq_x", "seq_y", "rank", "col"]
    a, b = (t.toPandas().sort_values(key).reset_index(drop=True) for t in (chain.align_next(table), chain.align_pairs(cells)))
    assert set(a.seq_x) == {str(i) for i in range(6)} and a.equals(b)


@pytest.mark.parametrize("w", [Weights(), Weights(0.4, 0.01, 0.2, 3.0), Weights(5.0, 0.001, 0.001, 0.001)])
def test_best_scores_of_many_pairs(spark, w):
    df = many_pairs(6, seed=8)
    groups = spark.createDataFrame([(str(p), str(p + i), i) for p in range(5) for i in (0, 1)] + [("none", "0", 0)], "group string, seq string, nth int")
    packed = chain.packed_pairs(spark.createDataFrame(df).join(groups, "seq"), ["group"])
    got = {r["group"]: r["score"] for r in chain.best_scores(packed, w).collect()}
    want = {str(p): chain.aligned_frame(df[df.seq.isin([str(p), str(p + 1)])], [str(p), str(p + 1)], 1, w).module_score.iloc[0] for p in range(5)}
    assert got == want


@pytest.mark.parametrize("method", ["pairs", "general", "representative"])
@pytest.mark.parametrize("most", [20, 10**6])
def test_tree_of_all_rows_at_once_is_as_row_by_row(monkeypatch, method, most):
    monkeypatch.setattr(tree, "_CELLS", most)
    df = random_sites(11, "abcde", 12, 300)
    df["score"] = np.ceil(df.score)  # equal scores
    root = parse_newick("(((0,1),2),(3,4));", {str(i) for i in range(5)})
    got = tree.tree_frame(df, root, dict(zip("01234", "abcde")), 5, method, 9, Weights())
    labels = {k: i for i, k in enumerate(sorted(set(zip(df.motif, df.strand))))}
    found = {}
    for node in root.post_order():
        if node.name is not None:
            own = df[df.seq == "abcde"[int(node.name)]].sort_values(["begin", "end", "motif", "strand"], kind="stable")
            found[node.number] = [(0.0, tree.Columns([own.seq.iloc[0]], np.array([labels[k] for k in zip(own.motif, own.strand)]), *(own[c].to_numpy()[:, None] for c in ("begin", "end", "score"))), None)]
            continue
        left, right = (found[c.number] for c in node.children)
        each = (9, 3, 1)[sum(c.name is None for c in node.children)]
        parts = [x for _, a, _ in left for _, b, _ in right for x in tree.aligned_columns(a, b, each, method, Weights())]
        found[node.number] = sorted(parts, key=lambda p: (-p[0], p[1].begin.tolist(), p[1].end.tolist(), p[1].label.tolist()))[:9]
    assert len(found[root.number]) >= 5
    for (m, own), (score, c, running) in zip(got.groupby("module"), found[root.number]):
        first = own.groupby("col").first()
        assert score == own.module_score.iloc[0] and first.cum_score.tolist() == running.tolist()
        assert own.begin.tolist() == c.begin.ravel().tolist() and own.weight.tolist() == c.weight.ravel().tolist()
