"""Position frequency matrices: four rows of counts, A C G T, a file each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_motifs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """motif, pos, base, count. Lines of two characters or less are skipped; a file must then have four rows of equal width.

    A motif is named by its path without the folders that all files share; a file given twice counts once.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines")).dropDuplicates(["file"])
    names = [r["file"] for r in lines.select("file").collect()]
    common = os.path.commonprefix([n.split("/")[:-1] for n in names])
    folder = "".join(f"{part}/" for part in common)
    rows = lines.select("file", F.filter("lines", lambda x: F.length(F.trim(x)) > 2).alias("rows"))
    wrong = F.size("rows") != 4
    rows = rows.select("file", F.when(wrong, F.raise_error(F.concat(F.lit("not four rows: "), F.col("file")))).otherwise(F.col("rows")).alias("rows"))
    cells = rows.select(F.expr(f"substring(file, {len(folder) + 1})").alias("motif"), F.posexplode("rows").alias("row", "line"))
    cells = cells.select("motif", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("pos", "count"))
    return cells.select("motif", "pos", F.substring(F.lit("ACGT"), F.col("row") + 1, F.lit(1)).alias("base"), F.col("count").cast("double").alias("count"))


def motifs_of(spark: SparkSession, matrices: dict[str, list[list[float]]]) -> DataFrame:
    """The same from literal matrices."""
    rows = [(name, j, "ACGT"[i], float(c)) for name, m in matrices.items() for i, line in enumerate(m) for j, c in enumerate(line)]
    return spark.createDataFrame(rows, schemas.MOTIFS)
