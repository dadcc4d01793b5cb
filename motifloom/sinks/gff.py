"""Sites and modules as GFF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.penalty import Weights
from ..functions.text import short_number


def allele_text(snps: Column) -> Column:
    """Code, allele and offset, and the difference of scores, of each record between tabs."""
    return F.array_join(F.transform(snps, lambda s: F.format_string("%s%s%d %s", s["ambig"], s["allele"], s["offset"], short_number(s["score_diff"]))), "\t")


def site_lines(sites: DataFrame, source: str = "scan") -> DataFrame:
    """One line a site: nine fields between tabs."""
    fields = ["seq", F.lit(source), "motif", F.col("begin").cast("string"), F.col("end").cast("string"), F.format_string("%f", "score"), "strand", F.lit("."), allele_text(F.col("snps"))]
    return sites.select(F.concat_ws("\t", *fields).alias("value"))


def module_lines(columns: DataFrame, weights: Weights = Weights(), descriptions: DataFrame | None = None, model: DataFrame | None = None, tags: DataFrame | None = None, tag_length: int = 50) -> DataFrame:
    """place, value: the lines of a module file, to be put in order of place.

    A header; a line for each sequence; for every module a CisModule line a sequence (with its partner if there are
    two), then a line a site with what its column adds. model: one row of expectation_model; tags: seq_id, seq of the
    sequences, for the first and last letters of each module.
    """
    spark = columns.sparkSession
    head = "### lambda=%f mu=%f nu=%f xi=%f Nucleotides per rotation=%f" % (weights.lam, weights.mu, weights.nu, weights.xi, weights.rotation)
    names = columns.select("seq").distinct()
    if descriptions is not None:
        names = names.join(descriptions.select(F.col("seq_id").alias("seq"), "description"), "seq", "left")
    else:
        names = names.withColumn("description", F.lit(""))
    place = lambda *parts: F.array(*(F.lit(p) if isinstance(p, int) else p.cast("int") for p in parts))
    top = spark.createDataFrame([(head,)], "value string").select(place(0, 0, 0, 0).alias("place"), F.lit("").alias("seq"), "value")
    named = names.select(place(1, 0, 0, 0).alias("place"), "seq", F.concat(F.lit("#"), "seq", F.lit("\t"), F.coalesce("description", F.lit(""))).alias("value"))
    spans = columns.groupBy("module", "seq").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("cum_score").alias("score"))
    by = Window.partitionBy("module")
    others = F.filter(F.collect_list(F.struct("seq", "begin", "end")).over(by), lambda o: o["seq"] != F.col("seq"))
    other = F.get(others, F.lit(0))
    tail = F.when(F.count(F.lit(1)).over(by) == 2, F.format_string('\tTarget "%s";\tStart %d;\tEnd %d;\tStrand .;\tFrame .;\t', other["seq"], other["begin"], other["end"])).otherwise("")
    spans = spans.withColumn("tail", tail)
    if model is not None and (m := model.first()) is not None and (m["r_squared"] or 0) > 0.1:
        spans = spans.withColumn("tail", F.concat("tail", F.lit("Escore "), short_number(F.exp(F.lit(m["alpha"]) + F.lit(m["beta"]) * F.col("score"))), F.lit("\t")))
    if tags is not None:
        spans = spans.join(tags.select(F.col("seq_id").alias("seq"), F.col("seq").alias("letters")), "seq", "left")
        own = F.col("letters").substr(F.col("begin"), F.col("end") - F.col("begin") + 1)
        spans = spans.withColumn("tail", F.concat("tail", F.lit("Tag5 "), F.substring(own, 1, tag_length), F.lit("\tTag3 "), F.right(own, F.lit(tag_length)), F.lit("\t")))
    module_row = F.format_string("%s\tmalign\tCisModule\t%d\t%d\t%4.2f\t.\t.\t%sCM %d", "seq", "begin", "end", "score", F.coalesce("tail", F.lit("")), "module")
    heads = spans.select(place(2, F.col("module"), 0, 0).alias("place"), "seq", module_row.alias("value"))
    site_row = F.concat(F.format_string("%s\tmalign\t%s\t%d\t%d\t%4.2f\t%s\t.\tCM %d\tMW ", "seq", "motif", "begin", "end", "delta", "strand", "module"), short_number(F.col("weight")), F.format_string("\tCOL %d\t", "col"))
    sites = columns.select(place(2, F.col("module"), 1, F.col("col")).alias("place"), "seq", site_row.alias("value"))
    return top.unionByName(named).unionByName(heads).unionByName(sites).withColumn("place", F.struct("place", "seq")).drop("seq")


def anchor_lines(columns: DataFrame, x: str | Column, y: str | Column) -> DataFrame:
    """module, col, value: x, y, where the site begins in each, its end less its begin, and what the column adds.

    x, y: names, or columns with the names of each module's two sequences.
    """
    named = columns.withColumns({"x_": F.lit(x), "y_": F.lit(y)})
    sides = named.groupBy("module", "col", "x_", "y_").agg(*(F.max(F.when(F.col("seq") == F.col(s), F.col(c))).alias(f"{c}_{n}") for s, n in (("x_", "x"), ("y_", "y")) for c in ("begin", "end")), F.max("delta").alias("delta"))
    fields = ["x_", "y_", F.col("begin_x").cast("string"), F.col("begin_y").cast("string"), (F.col("end_x") - F.col("begin_x")).cast("string"), F.col("delta").cast("string")]
    return sides.select("module", "col", F.concat_ws("\t", *fields).alias("value"))


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    """lines (value, and place for an order) as text, gzipped if the path ends in .gz.

    In order of place the lines go through range partitions, so that no one task holds the file.
    """
    if "place" in lines.columns:
        lines = lines.orderBy("place")
    writer = lines.select("value").write.mode("append" if append else "errorifexists")
    writer.text(path, compression="gzip" if path.endswith(".gz") else "none")
