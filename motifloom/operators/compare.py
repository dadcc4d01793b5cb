"""Comparisons of all pairs of motifs: relative entropy and expected score.

Both are joins of the long motif table with itself: for every ordered pair, strand
and shift the positions of one motif meet those of the other, or the background
where the other has none. Motif tables are small, and the pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import motifs as M


def _both_strands(table: DataFrame) -> DataFrame:
    flipped = M.reverse_complement(table)
    return table.withColumn("strand", F.lit("+")).unionByName(flipped.withColumn("strand", F.lit("-")))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every motif of a with every motif of b."""
    names = b.agg(F.collect_list(F.struct("motif", "width")).alias("others"))
    return a.withColumn("key", F.lit(0)).join(F.broadcast(names.withColumn("key", F.lit(0))), "key").select(F.col("motif").alias("a"), F.col("width").alias("a_width"), F.explode("others").alias("o")).select("a", "a_width", F.col("o.motif").alias("b"), F.col("o.width").alias("b_width"))


def relative_entropy(motifs: DataFrame, background: Sequence[float] = M.UNIFORM, pseudocount: float = 1.0) -> DataFrame:
    """a, b, distance, shift for all ordered pairs: the least of D(a|b) and D(b|a) over shifts and strands.

    The distance is taken over the positions of the shorter motif, the longer one's frequencies giving way to the
    background beyond its ends. Of two motifs of equal width either may be the longer. 0 for a motif and itself.
    """
    table = M.derived(motifs, background, pseudocount).select("motif", "pos", "base", "freq")
    widths = table.groupBy("motif").agg((F.max("pos") + 1).alias("width"))
    pairs = _pairs(widths, widths).where("a != b")
    long_first = pairs.where("a_width >= b_width").select(F.col("a").alias("long"), "a_width", F.col("b").alias("short"), "b_width")
    shifted = long_first.select("long", "short", F.explode(F.sequence(1 - F.col("b_width"), F.col("a_width") - 1)).alias("shift"))
    strands = _both_strands(table).select(F.col("motif").alias("short"), "strand", "pos", "base", F.col("freq").alias("p"))
    met = shifted.join(strands, "short").withColumn("at", F.col("pos") + F.col("shift"))
    other = table.select(F.col("motif").alias("long"), F.col("pos").alias("at"), "base", F.col("freq").alias("q"))
    met = met.join(other, ["long", "at", "base"], "left").withColumn("q", F.coalesce("q", M.base_probability(F.col("base"), background)))
    sums = met.groupBy("long", "short", "shift", "strand").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("d1"), F.sum(F.col("q") * F.log2(F.col("q") / F.col("p"))).alias("d2"))
    best = sums.groupBy("long", "short").agg(F.min(F.struct(F.least("d1", "d2").alias("distance"), "shift")).alias("m"))
    both = best.select(F.col("long").alias("a"), F.col("short").alias("b"), "m.distance", "m.shift").unionByName(best.select(F.col("short").alias("a"), F.col("long").alias("b"), "m.distance", (-F.col("m.shift")).alias("shift")))
    least = both.groupBy("a", "b").agg(F.min(F.struct("distance", F.abs("shift").alias("s"), "shift")).alias("m")).select("a", "b", "m.distance", "m.shift")
    own = widths.select(F.col("motif").alias("a"), F.col("motif").alias("b"), F.lit(0.0).alias("distance"), F.lit(0).alias("shift"))
    return least.unionByName(own)


def expected_score(motifs: DataFrame, background: Sequence[float] = M.UNIFORM, pseudocount: float = 1.0) -> DataFrame:
    """a, b, score, shift for all ordered pairs: the highest expected score of a on sites of b, over shifts 0, 1, ... and strands."""
    table = M.derived(motifs, background, pseudocount).select("motif", "pos", "base", "freq", "weight")
    widths = table.groupBy("motif").agg((F.max("pos") + 1).alias("width"))
    shifted = _pairs(widths, widths).select("a", "b", F.explode(F.sequence(F.lit(0), F.col("b_width") - 1)).alias("shift"))
    shifted = shifted.select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    own = table.select(F.col("motif").alias("a"), "pos", "base", "weight")
    met = shifted.join(own, "a").withColumn("at", F.col("pos") + F.col("shift"))
    other = _both_strands(table.select("motif", "pos", "base", "freq")).select(F.col("motif").alias("b"), "strand", F.col("pos").alias("at"), "base", F.col("freq").alias("p"))
    met = met.join(other, ["b", "strand", "at", "base"], "left").withColumn("p", F.coalesce("p", M.base_probability(F.col("base"), background)))
    sums = met.groupBy("a", "b", "shift", "strand").agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
    best = sums.groupBy("a", "b").agg(F.max(F.struct("score", (-F.col("shift")).alias("s"))).alias("m"))
    return best.select("a", "b", "m.score", (-F.col("m.s")).alias("shift"))


def as_matrix(pairs: DataFrame, value: str) -> DataFrame:
    """One row a motif, one column for each other."""
    return pairs.groupBy("a").pivot("b").agg(F.first(value)).orderBy("a")
