"""The star schema of module files: nine tables from one staging table.

staging: file, species, gene, gene_name, strand (Watson or Crick of the slice),
db, chromosome, slice_start, slice_end, kind (CisModule or a factor), begin, end,
score, site_strand, module (of the row's file), weight. Keys are numbers by the
order of the natural keys, so a load gives the same keys every time. The rows of
a table are dealt by ranges of that order, numbered within each range, and moved
on by the number of rows in the ranges before, so no task gets a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

STAGING = (
    "file string, species string, gene string, gene_name string, strand string, db string, chromosome string, slice_start int, slice_end int, "
    "kind string, begin int, end int, score double, site_strand string, module int, weight double"
)
_HEAD = "CisModule"


def species_of(gene: Column) -> Column:
    """The species that a gene's code names, by its letters."""
    return F.when(gene.like("ENSG%"), "HUMAN").when(gene.like("ENSMUS%"), "MOUSE")


def numbered(rows: DataFrame, *natural: str) -> DataFrame:
    """rows with id: 1, 2, ... in order of the natural key."""
    dealt = stored(rows.repartitionByRange(*natural).withColumn("range_", F.spark_partition_id()), "numbered")
    before = F.sum("rows_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"))  # one row a partition
    offsets = ranges.select("range_", F.coalesce(before, F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*natural))
    return dealt.join(F.broadcast(offsets), "range_").withColumn("id", (F.col("before_") + own).cast("int")).drop("range_", "before_")


def factors(staging: DataFrame) -> DataFrame:
    """id, name, width; the first width by size where a factor has several."""
    rows = staging.where(F.col("kind") != _HEAD).groupBy(F.col("kind").alias("name")).agg(F.min(F.col("end") - F.col("begin")).alias("width"))
    return numbered(rows, "name").select("id", "name", "width")


def sequences(staging: DataFrame) -> DataFrame:
    return numbered(staging.select("species", "chromosome", "db").distinct(), "species", "chromosome", "db").select("id", "species", F.col("chromosome").alias("name"), "db")


def slices(staging: DataFrame, seqs: DataFrame) -> DataFrame:
    own = staging.select("species", "chromosome", "db", "slice_start", "slice_end", "gene", "gene_name", "strand", "file").distinct()
    keyed = own.join(seqs.select(F.col("id").alias("seq_id"), "species", F.col("name").alias("chromosome"), "db"), ["species", "chromosome", "db"])
    rows = keyed.select("seq_id", F.col("slice_start").alias("begin"), F.col("slice_end").alias("end"), "gene", "gene_name", F.when(F.col("strand") == "Crick", 1).otherwise(0).alias("reverse"), "file").distinct()
    return numbered(rows, "file", "gene", "seq_id", "begin", "end", "reverse", "gene_name").select("id", "seq_id", "begin", "end", "gene", "gene_name", "reverse", "file")


def modules(staging: DataFrame) -> DataFrame:
    rows = staging.where(F.col("kind") == _HEAD).groupBy("file", "module").agg(F.max("score").alias("score"))
    return numbered(rows, "file", "module").select("id", "file", "module", "score")


def module_slices(staging: DataFrame, mods: DataFrame, slices_: DataFrame) -> DataFrame:
    heads = staging.where(F.col("kind") == _HEAD).select("file", "module", "gene").distinct()
    keyed = heads.join(mods.select(F.col("id").alias("module_id"), "file", "module"), ["file", "module"])
    return keyed.join(slices_.select(F.col("id").alias("slice_id"), "file", "gene"), ["file", "gene"]).select("module_id", "slice_id").distinct()


def regions(staging: DataFrame, mods: DataFrame, seqs: DataFrame) -> DataFrame:
    heads = staging.where(F.col("kind") == _HEAD)
    keyed = heads.join(mods.select(F.col("id").alias("module_id"), "file", "module"), ["file", "module"])
    keyed = keyed.join(seqs.select(F.col("id").alias("seq_id"), "species", F.col("name").alias("chromosome"), "db"), ["species", "chromosome", "db"])
    rows = keyed.select("seq_id", (F.col("slice_start") + F.col("begin")).alias("begin"), (F.col("slice_start") + F.col("end")).alias("end"), "module_id").distinct()
    return numbered(rows, "module_id", "seq_id", "begin", "end").select("id", "seq_id", "begin", "end", "module_id")


def columns(staging: DataFrame, mods: DataFrame, facts: DataFrame, species: str = "HUMAN") -> DataFrame:
    """id, module_id, nth (from 1, in order of begin on one species), factor_id, delta."""
    rows = staging.where((F.col("kind") != _HEAD) & (F.col("species") == species))
    keyed = rows.join(mods.select(F.col("id").alias("module_id"), "file", "module"), ["file", "module"]).join(facts.select(F.col("id").alias("factor_id"), F.col("name").alias("kind")), "kind")
    nth = F.row_number().over(Window.partitionBy("module_id").orderBy("begin", "end", "kind", "site_strand", "score"))
    out = keyed.withColumn("nth", nth).select("module_id", "nth", "factor_id", F.col("score").alias("delta"))
    return numbered(out, "module_id", "nth").select("id", "module_id", "nth", "factor_id", "delta")


def sites(staging: DataFrame, regions_: DataFrame, mods: DataFrame, seqs: DataFrame, cols: DataFrame) -> DataFrame:
    """id, region_id, nth, column_id, pos, strand, weight: sites on the forward strand, joined to the column of their place."""
    rows = staging.where(F.col("kind") != _HEAD)
    keyed = rows.join(mods.select(F.col("id").alias("module_id"), "file", "module"), ["file", "module"])
    keyed = keyed.join(seqs.select(F.col("id").alias("seq_id"), "species", F.col("name").alias("chromosome"), "db"), ["species", "chromosome", "db"])
    keyed = keyed.join(regions_.select(F.col("id").alias("region_id"), "module_id", "seq_id"), ["module_id", "seq_id"])
    crick = F.col("strand") == "Crick"
    nth = F.row_number().over(Window.partitionBy("region_id").orderBy("begin", "end", "kind", "site_strand", "score", "weight", "strand"))
    placed = keyed.withColumn("nth", nth).select(
        "region_id", "nth", "module_id", "weight",
        F.when(crick, F.col("slice_end") - F.col("end")).otherwise(F.col("slice_start") + F.col("begin")).alias("pos"),
        F.when(crick, F.when(F.col("site_strand") == "-", "+").otherwise("-")).otherwise(F.col("site_strand")).alias("strand"),
    )
    out = placed.join(cols.select(F.col("id").alias("column_id"), "module_id", "nth"), ["module_id", "nth"])
    return numbered(out, "region_id", "nth").select("id", "region_id", "nth", "column_id", "pos", "strand", "weight")


#: Each table from those that it refers to, by name.
_TABLES = {
    "sequence": lambda s, t: sequences(s),
    "factor": lambda s, t: factors(s),
    "module": lambda s, t: modules(s),
    "slice": lambda s, t: slices(s, t("sequence")),
    "module_slice": lambda s, t: module_slices(s, t("module"), t("slice")),
    "region": lambda s, t: regions(s, t("module"), t("sequence")),
    "column": lambda s, t: columns(s, t("module"), t("factor")),
    "site": lambda s, t: sites(s, t("region"), t("module"), t("sequence"), t("column")),
    "gene_description": lambda s, t: s.select("gene", F.current_date().alias("modified"), F.col("gene_name").alias("description")).distinct(),
}


def star(staging: DataFrame, *names: str) -> dict[str, DataFrame]:
    """The named tables of a load and those that they refer to; all if none is named."""
    made: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in made:
            made[name] = _TABLES[name](staging, table)
        return made[name]

    for name in names or _TABLES:
        table(name)
    return made


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
