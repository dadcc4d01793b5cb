"""Site and module tables: filters, coordinates, order, randomising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.penalty import Weights, step_penalty_column

REACH = 1000  # a step's gap plus one is below this


def without_sequences(table: DataFrame, pattern: str, column: str = "seq") -> DataFrame:
    """Rows whose sequence name does not begin with a match of pattern; for sequences and for sites."""
    return table.where(~F.col(column).rlike(f"^(?:{pattern})"))


def without_motif(motifs: DataFrame, index: int) -> DataFrame:
    """motifs without the one at a place (from 0) in order of name."""
    ranked = motifs.withColumn("i_", F.dense_rank().over(Window.orderBy("motif")))  # a motif table is small
    return ranked.where(F.col("i_") != index + 1).drop("i_")


def only(sites: DataFrame, *sequences: str) -> DataFrame:
    return sites.where(F.col("seq").isin(*sequences))


def part(sites: DataFrame, first: Column | int, last: Column | int, *ties: str) -> DataFrame:
    """Sites by place in their sequence, from 0, both ends included; of sites alike in place, motif and strand, by the columns of ties."""
    nth = F.row_number().over(ordered_by_sequence(*ties)) - 1
    return sites.withColumn("i_", nth).where(F.col("i_").between(first, last)).drop("i_")


def ordered_by_sequence(*ties: str) -> Window:
    return Window.partitionBy("seq").orderBy("begin", "end", "motif", "strand", *ties)


def head(sites: DataFrame, n: int) -> DataFrame:
    """Sites among the n lowest begins of their sequence; ties are kept."""
    rank = F.rank().over(Window.partitionBy("seq").orderBy("begin"))
    return sites.withColumn("r_", rank).where(F.col("r_") <= n).drop("r_")


def match_counts(sites: DataFrame) -> DataFrame:
    """seq, n; and one row without a name for all."""
    return sites.rollup("seq").agg(F.count(F.lit(1)).alias("n"))


def shifted(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Sites on slices moved to the whole. names: seq, new_seq, offset; a site on a slice not named there stays."""
    out = sites.join(names, "seq", "left")
    add = F.coalesce("offset", F.lit(0))
    return out.withColumns({"begin": F.col("begin") + add, "end": F.col("end") + add, "seq": F.coalesce("new_seq", "seq")}).drop("new_seq", "offset")


def without_strand(sites: DataFrame) -> DataFrame:
    return sites.withColumn("strand", F.lit("."))


def on_forward_strand(sites: DataFrame, crick: Column, start: Column, stop: Column) -> DataFrame:
    """Coordinates within a slice mapped to the whole: counted from stop, with the other strand, where crick holds.

    A negative stop counts from the end and is taken by its size.
    """
    size = F.abs(stop)
    flipped = F.translate("strand", "+-", "-+")
    return sites.select(
        *(c for c in sites.columns if c not in ("begin", "end", "strand")),
        F.when(crick, size - F.col("end") + 1).otherwise(start + F.col("begin") - 1).alias("begin"),
        F.when(crick, size - F.col("begin") + 1).otherwise(start + F.col("end") - 1).alias("end"),
        F.when(crick, flipped).otherwise(F.col("strand")).alias("strand"),
    )


def randomised(sites: DataFrame, seed: int) -> DataFrame:
    """The positions of a sequence's sites dealt anew among them; every row and every position stays. Ends follow the widths."""
    by = Window.partitionBy("seq")
    what = sites.withColumn("i_", F.row_number().over(by.orderBy("begin", "end", "motif", "strand", "score")))
    mixed = F.xxhash64(F.lit(seed), "seq", "i_")
    dealt = what.withColumn("j_", F.row_number().over(by.orderBy(mixed, "i_")))
    where = dealt.select(F.col("seq").alias("s_"), F.col("j_").alias("k_"), F.col("begin").alias("new_"))
    out = dealt.join(where, (F.col("seq") == F.col("s_")) & (F.col("i_") == F.col("k_")))
    return out.withColumn("end", F.col("new_") + F.col("end") - F.col("begin")).withColumn("begin", F.col("new_")).select(*sites.columns)


def random_sequences(spark, n: int, length: int, seed: int, composition: dict[str, float] | None = None) -> DataFrame:
    """n sequences, each a shuffle of the same composition."""
    shares = composition or dict.fromkeys("ACGT", 0.25)
    letters, total = "", 0.0
    for b, p in shares.items():
        total += p
        letters += b * (round(total * length) - len(letters))
    places = F.sequence(F.lit(1), F.lit(length))
    keyed = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("id"), i).alias("h"), F.lit(letters).substr(i, F.lit(1)).alias("b")))
    return spark.range(n).select(F.concat(F.lit("random"), F.col("id")).alias("seq_id"), F.lit("").alias("description"), F.array_join(F.transform(F.array_sort(keyed), lambda x: x["b"]), "").alias("seq"))


def cells(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of sites of one motif and strand: seq_x, seq_y, motif, strand, begin, end and weight of both."""
    side = lambda t, s: t.select("motif", "strand", *(F.col(c).alias(f"{n}_{s}") for c, n in (("seq", "seq"), ("begin", "begin"), ("end", "end"), ("score", "weight"))))
    return side(x, "x").join(side(y, "y"), ["motif", "strand"])


def steps(cells_: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """The steps that a chain may take between cells of one pair of sequences, with their penalties.

    cells_ must have an id. A cell's successors begin after it in both sequences, by less than REACH. The join is on a
    bucket of REACH letters of x, in which or in the next of which a successor begins.
    """
    keep = ("id", "begin_x", "end_x", "begin_y", "end_y")
    a = cells_.select("seq_x", "seq_y", *(F.col(c).alias(f"a_{c}") for c in keep), F.floor(F.col("end_x") / REACH).alias("bucket"))
    here = F.floor(F.col("begin_x") / REACH)
    b = cells_.select("seq_x", "seq_y", *(F.col(c).alias(f"b_{c}") for c in keep), F.explode(F.array(here - 1, here)).alias("bucket"))
    gap_x, gap_y = (F.col(f"b_begin_{s}") - F.col(f"a_end_{s}") for s in "xy")
    met = a.join(b, ["seq_x", "seq_y", "bucket"]).where((gap_x > 0) & (gap_x < REACH) & (gap_y > 0) & (gap_y < REACH))
    return met.select("seq_x", "seq_y", F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), step_penalty_column(gap_x - 1, gap_y - 1, weights).alias("penalty"))


def with_delta(columns: DataFrame) -> DataFrame:
    """columns with delta: what each column adds to its module's score."""
    before = F.lag("cum_score", 1, 0.0).over(Window.partitionBy("module", "seq").orderBy("col"))
    return columns.withColumn("delta", F.col("cum_score") - before)


def extents(columns: DataFrame) -> DataFrame:
    """module, seq, begin, end, score (the highest running one)."""
    return columns.groupBy("module", "seq").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("cum_score").alias("score"))


def top(table: DataFrame, by: list[str], score: str, n: int, *ties: str) -> DataFrame:
    """The n highest rows of each group; ties go by the further columns."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def down_to(modules: DataFrame, by: list[str], bound: float) -> DataFrame:
    """Modules above bound, and the first one at or below it."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "module")
    before = F.lag("score").over(order)
    return modules.withColumn("b_", before).where(F.col("b_").isNull() | (F.col("b_") > bound)).drop("b_")


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key neither old nor an earlier row of new has."""
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti").select(*old.columns))


def well_supported(columns: DataFrame, least: int, support: str = "pairs") -> DataFrame:
    return columns.where(F.col(support) >= least)
