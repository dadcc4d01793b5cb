"""Motif tables: frequencies, weights, information, complements, exports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_number

UNIFORM = (0.25, 0.25, 0.25, 0.25)


def base_probability(base: Column, background: Sequence[float] = UNIFORM) -> Column:
    out = F.lit(None).cast("double")
    for b, p in zip("ACGT", background, strict=True):
        out = F.when(base == b, F.lit(float(p))).otherwise(out)
    return out


def derived(motifs: DataFrame, background: Sequence[float] = UNIFORM, pseudocount: float = 1.0) -> DataFrame:
    """motif, pos, base, count with freq, weight (log odds to the background), positive_weight (log of freq) and info."""
    if pseudocount <= 0:
        pseudocount = 1.0
    p = base_probability(F.col("base"), background)
    total = F.sum("count").over(Window.partitionBy("motif", "pos")) + F.lit(float(pseudocount))
    smoothed = F.col("count") + p * pseudocount
    out = motifs.withColumn("freq", smoothed / total).withColumn("p", p)
    out = out.withColumns({"weight": F.log2(F.col("freq") / F.col("p")), "positive_weight": F.log2("freq"), "info": F.col("freq") * F.log2(F.col("freq") / F.col("p"))})
    return out.drop("p")


def summary(derived_motifs: DataFrame) -> DataFrame:
    """motif, width, info (summed over all cells), max_score."""
    at = derived_motifs.groupBy("motif", "pos").agg(F.sum("info").alias("info"), F.max("weight").alias("top"))
    return at.groupBy("motif").agg(F.count(F.lit(1)).cast("int").alias("width"), F.sum("info").alias("info"), F.sum("top").alias("max_score"))


def reverse_complement(motifs: DataFrame) -> DataFrame:
    """The same counts read from the other strand."""
    last = F.max("pos").over(Window.partitionBy("motif"))
    return motifs.withColumns({"pos": last - F.col("pos"), "base": F.translate("base", "ACGT", "TGCA")})


def column_scaled(motifs: DataFrame) -> DataFrame:
    """Counts scaled so that every position has the motif's grand total, rounded."""
    grand = F.sum("count").over(Window.partitionBy("motif"))
    own = F.sum("count").over(Window.partitionBy("motif", "pos"))
    return motifs.withColumn("count", F.round(grand * F.col("count") / own))


def column_shares(motifs: DataFrame) -> DataFrame:
    """motif, pos, base, share of the position's total, and the base's place by share (0 at the bottom of a logo)."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy("motif", "pos"))
    order = Window.partitionBy("motif", "pos").orderBy("share", "base")
    return motifs.withColumn("share", share).withColumn("place", F.row_number().over(order) - 1).drop("count")


def matrices(motifs: DataFrame, column: str) -> dict[str, np.ndarray]:
    """Every motif's 4 x width matrix of a column; motif tables are small by nature (their number times their width)."""
    rows = motifs.select("motif", "pos", "base", column).collect()
    width: dict[str, int] = {}
    for r in rows:
        width[r["motif"]] = max(width.get(r["motif"], 0), r["pos"] + 1)
    out = {m: np.zeros((4, w)) for m, w in sorted(width.items())}
    for r in rows:
        out[r["motif"]]["ACGT".index(r["base"]), r["pos"]] = r[column]
    return out


def wide(motifs: DataFrame, column: str = "count") -> DataFrame:
    """motif, pos, A, C, G, T."""
    return motifs.groupBy("motif", "pos").pivot("base", list("ACGT")).agg(F.first(column))


def exported(motifs: DataFrame, style: str) -> DataFrame:
    """motif, text: one matrix in another program's format.

    matcompare: `M.name`, a tab-separated line a position, `END`; ahab: `>name Matrix width`, the lines, `<`;
    columns: the lines alone; cisevolver: lines of smoothed frequencies.
    """
    line = F.format_string("%f %f %f %f", "A", "C", "G", "T") if style == "cisevolver" else F.concat_ws("\t", *(short_number(F.col(b)) for b in "ACGT"))
    table = wide(derived(motifs), "freq") if style == "cisevolver" else wide(motifs)
    lines = table.withColumn("line", line).groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    head, foot = {
        "matcompare": (F.format_string("M.%s\n", "motif"), F.lit("\nEND")),
        "ahab": (F.format_string(">%s Matrix\t%d\n", "motif", F.size("l")), F.lit("\n<")),
        "columns": (F.lit(""), F.lit("\n")),
        "cisevolver": (F.lit(""), F.lit("\n")),
    }[style]
    return lines.select("motif", F.concat(head, body, foot).alias("text"))


def example_sites(motifs: DataFrame) -> DataFrame:
    """motif, site, seq: as many sequences as the first position has counts, together with the counts of every position."""
    first = Window.partitionBy("motif", "pos").orderBy("base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = motifs.withColumn("upto", F.sum(F.col("count").cast("long")).over(first))
    each = upto.where("count >= 1").select("motif", "pos", "base", F.explode(F.sequence(F.col("upto") - F.col("count").cast("long"), F.col("upto") - 1)).alias("site"))
    known = motifs.where("pos = 0").groupBy("motif").agg(F.sum(F.col("count").cast("long")).alias("n"))
    joined = each.join(known, "motif").where(F.col("site") < F.col("n")).groupBy("motif", "site").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("s"))
    return joined.select("motif", "site", F.array_join(F.transform("s", lambda x: x["base"]), "").alias("seq"))
