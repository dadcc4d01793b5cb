"""Alignments of site lists: pairs, triples, trees, merged modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.penalty import Weights
from ..operators import chain, merge, stats, tree
from ..sinks import gff, text
from ..sources.trees import parse_newick
from ..storage import stored
from . import inputs as I

#: The tree of every five sequences in a row, by their places.
TREE = "(((0,1),2),(3,4));"


def align_pairs(spark, sf_dir):
    """The three best modules of every sequence with the next."""
    return chain.align_next(I.sites(spark, sf_dir), 3)


def _groups(spark, sf_dir, size: int):
    names = I.sites(spark, sf_dir).select("seq").distinct()
    each = names.select("seq", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("nth"))
    grouped = each.withColumn("group", (F.col("seq").cast("long") - F.col("nth")).cast("string"))
    full = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size).select("group")
    return grouped.join(full, "group")


def align_triples(spark, sf_dir):
    return chain.align_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, 3), 2)


def align_triples_gapped(spark, sf_dir):
    return chain.align_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, 3), 1, bonus="chain", gap_limit=1)


def align_next_best(spark, sf_dir):
    return chain.align_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, 2), 3, keep_scores=True)


def align_down_to(spark, sf_dir):
    return chain.align_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, 2), 0, down_to=2500.0)


def align_near_pairs(spark, sf_dir):
    """The best module of every three sequences in a row, on the third's sites and those near the first two's pairwise modules."""
    return near_pairs_of(I.sites(spark, sf_dir), _groups(spark, sf_dir, 2), _groups(spark, sf_dir, 3))


def near_pairs_of(sites, pairs, triples):
    """pairs, triples: group, seq, nth. A triple's pair is that of its group."""
    found = stored(chain.align_groups(sites, pairs, 3), "pair")
    spans = found.groupBy("group", "module", "seq").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    third = sites.join(triples.where("nth = 2"), "seq").groupBy("group", "seq").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return chain.align_groups_near_pairs(sites, spans.select("group", "seq", "begin", "end").unionByName(third), triples)


def _tree(spark, sf_dir, method: str):
    names = {str(i) for i in range(5)}
    return tree.align_tree_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, 5), parse_newick(TREE, names), 3, method=method)


def align_tree_pairs(spark, sf_dir):
    return _tree(spark, sf_dir, "pairs")


def align_tree_general(spark, sf_dir):
    return _tree(spark, sf_dir, "general")


def align_tree_representative(spark, sf_dir):
    return _tree(spark, sf_dir, "representative")


def _pairwise(spark, sf_dir):
    """The pairwise modules as sites with numbered modules, and the modules' scores."""
    found = align_pairs(spark, sf_dir)
    number = F.col("seq_x").cast("long") * 10 + F.col("rank")
    sides = F.array(*(F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("seq", "begin", "end"))) for s in "xy"))
    rows = found.select(number.alias("module"), "col", "motif", "strand", "score", F.explode(sides).alias("side"))  # a union would align twice
    return stored(rows.select("module", "col", "side.seq", "motif", "strand", "side.begin", "side.end", "score"), "pairwise")


def merge_modules(spark, sf_dir):
    sites = _pairwise(spark, sf_dir)
    return merge.merge_modules(sites, sites.groupBy("module").agg(F.first("score").alias("score")))


def module_overlaps(spark, sf_dir):
    return merge.overlaps(_pairwise(spark, sf_dir))


def contained_modules(spark, sf_dir):
    return merge.contained(_pairwise(spark, sf_dir))


def numbered(found):
    """Columns of the modules of groups, module as one number over all groups: the group's ten times, and the rank."""
    return found.withColumn("module", (F.col("group").cast("long") * 10 + F.col("module")).cast("int"))


def _modules(spark, sf_dir, size: int):
    """Columns of the three best modules of every so many sequences in a row."""
    return stored(numbered(chain.align_groups(I.sites(spark, sf_dir), _groups(spark, sf_dir, size), 3)), "modules")


def score_terms(spark, sf_dir):
    return stats.score_terms(_modules(spark, sf_dir, 2))


def module_gff(spark, sf_dir):
    return gff.module_lines(_modules(spark, sf_dir, 2)).select("value")


def module_anchors(spark, sf_dir):
    return pair_anchors(_modules(spark, sf_dir, 2))


def pair_anchors(modules):
    return gff.anchor_lines(modules, F.col("group"), (F.col("group").cast("long") + 1).cast("string"))


def module_text(spark, sf_dir):
    return text.module_texts(_modules(spark, sf_dir, 2))


def pairwise_base(spark, sf_dir):
    """The columns of all pairs, and whether a column of any three sequences in a row has both sites."""
    return text.pairwise_base(_modules(spark, sf_dir, 2).drop("group"), _modules(spark, sf_dir, 3))


def parameter_search(spark, sf_dir):
    """Weights under which the best modules of all sequences with the next stand out most from those of the randomised sites."""
    w, got = stats.climb(pair_contrast(I.sites(spark, sf_dir), _groups(spark, sf_dir, 2)))
    return spark.createDataFrame([(w.lam, w.mu, w.nu, w.xi, got)], "lam double, mu double, nu double, xi double, value double")


def pair_contrast(sites, groups):
    """The value of weights: the pairs' best scores over those of their randomised sites, each summed; one job a value."""
    from ..operators.sites import randomised

    own = stored(sites, "search")
    side = lambda t, name: t.join(groups, "seq").withColumn("side", F.lit(name))
    both = stored(chain.packed_pairs(side(own, "own").unionByName(side(randomised(own, 3), "mixed")), ["side", "group"]), "search-cells")

    def value(w: Weights) -> float:
        sums = {r["side"]: r["score"] for r in chain.best_scores(both, w).groupBy("side").agg(F.sum("score").alias("score")).collect()}
        return sums.get("own", 0.0) / (sums.get("mixed", 0.0) + 1)

    return value


QUERIES = {f.__name__: f for f in (align_pairs, align_triples, align_triples_gapped, align_next_best, align_down_to, align_near_pairs, align_tree_pairs, align_tree_general, align_tree_representative, merge_modules, module_overlaps, contained_modules, score_terms, module_gff, module_anchors, module_text, pairwise_base, parameter_search)}

#: Chains can't be said in SQL; tests compare them with brute force and with published scores.
ORACLE_SQL: dict[str, str] = {}
