"""Site and module tables in GFF dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(value: Column, separator: str) -> Column:
    return F.split(F.trim(value), separator)


def read_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq, source, motif, begin, end, score, strand, frame, annotation of lines with seven fields at least; others are skipped."""
    f = F.col("f")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(_fields(F.col("value"), r"\s+").alias("f")).where(F.size("f") >= 7)
    return rows.select(
        f[0].alias("seq"), f[1].alias("source"), f[2].alias("motif"), f[3].cast("int").alias("begin"), f[4].cast("int").alias("end"), f[5].cast("double").alias("score"), f[6].alias("strand"),
        F.get(f, 7).alias("frame"), F.array_join(F.slice("f", 9, 10_000), " ").alias("annotation"),
    )


def attributes(tail: Column) -> Column:
    """Both tail dialects, `Key value;` and `KEY value` between tabs, as a map."""
    items = F.filter(F.transform(F.split(tail, r"[;\t|]"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_]\w*[ =]"))
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^\w+[ =]+(.*)$", 1), '^"|"$', "").alias("value")))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(k, F.filter(pairs, lambda p: p["key"] == k)[0]["value"])))


def read_modules(spark: SparkSession, path: str | list[str], separator: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Modules (file, module, seq, begin, end, score) and their sites (file, module, col, seq, motif, begin, end, delta, strand, weight).

    A row's module is its CM attribute; where it has none, the number of the last CisModule row above it in its file.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    raw = raw.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", r"\|" if separator == "|" else separator)
    rows = raw.select("file", "line", f.alias("f")).where(F.size("f") >= 7).select(
        "file", "line", F.trim(F.col("f")[0]).alias("seq"), F.trim(F.col("f")[2]).alias("kind"), F.col("f")[3].cast("int").alias("begin"), F.col("f")[4].cast("int").alias("end"),
        F.col("f")[5].cast("double").alias("score"), F.trim(F.col("f")[6]).alias("strand"), attributes(F.array_join(F.slice("f", 9, 10_000), "\t")).alias("a"),
    )
    head = F.col("kind") == "CisModule"
    above = Window.partitionBy("file").orderBy("line")
    opens = head & (F.lag("kind").over(above).isNull() | (F.lag("kind").over(above) != "CisModule"))
    carried = F.sum(opens.cast("int")).over(above)
    rows = rows.withColumn("module", F.coalesce(F.element_at("a", "CM").try_cast("int"), carried))
    modules = rows.where(head).select("file", "module", "seq", "begin", "end", "score")
    sites = rows.where(~head)
    nth = F.dense_rank().over(Window.partitionBy("file", "module").orderBy("line")) - 1
    sites = sites.select(
        "file", "module", F.coalesce(F.element_at("a", "COL").try_cast("int"), nth).alias("col"), "seq", F.col("kind").alias("motif"), "begin", "end",
        F.col("score").alias("delta"), "strand", F.element_at("a", "MW").try_cast("double").alias("weight"),
    )
    return modules, sites


def read_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    """Sites of pre-computed pairwise modules: files <right>_<left>.align.gff with pipes between the fields."""
    _, sites = read_modules(spark, f"{folder}/*.align.gff", "|")
    name = F.regexp_extract("file", r"([^/]*)\.align\.gff$", 1)
    return sites.withColumns({"right": F.substring_index(name, "_", 1), "left": F.substring_index(name, "_", -1)})


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a remote SQL source; the driver's JDBC class must be on Spark's class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_bulk(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """Delimited files in one load, with the name of each row's file."""
    return spark.read.csv(path, sep=separator, schema=schema, comment="#").withColumn("file", F.input_file_name())
