"""FASTA and EMBL files as sequences(seq_id, description, seq).

Files are read by Spark's own readers, so globs, compressed files and remote
stores work as for any source. FASTA records are split at the line that begins
with >, by the reader; a record longer than a task's memory should come as
chunks (operators.scan.chunked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _no_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s", "")


def _record(text: Column) -> list[Column]:
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    name = F.regexp_extract(head, r"^\s*(\S*)", 1)
    rest = F.trim(F.regexp_extract(head, r"^\s*\S*\s?([^\r\n]*)", 1))
    body = F.when(F.instr(text, "\n") > 0, F.substring_index(text, "\n", -1_000_000_000)).otherwise("")
    body = F.expr("substring(value, instr(value, '\n') + 1)")
    return [name.alias("seq_id"), rest.alias("description"), F.when(F.instr(text, "\n") > 0, _no_space(body)).otherwise("").alias("seq")]


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a record; where a name occurs twice in a run of files the last record, by file and place, stands."""
    raw = spark.read.text(path, lineSep="\n>").select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    raw = raw.withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.trim("value") != "")
    records = raw.select(*_record(F.col("value")), "file", "place")
    last = records.groupBy("seq_id").agg(F.max_by(F.struct("description", "seq"), F.struct("file", "place")).alias("r"))
    return last.select("seq_id", "r.description", "r.seq")


def parse_embl(text: Column) -> tuple[Column, Column, Column]:
    """Accession, description and sequence of an EMBL entry."""
    accession = F.regexp_extract(text, r"(?m)^AC\s+([^;\s]+)", 1)
    description = F.regexp_extract(text, r"(?m)^DE\s+([^\r\n]*)", 1)
    body = F.regexp_extract(text, r"(?s)\nSQ[^\n]*\n(.*?)(?://|$)", 1)
    return accession, description, F.upper(F.regexp_replace(body, r"[\s\d]", ""))


def read_embl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row an entry; entries end with //."""
    raw = spark.read.text(path, lineSep="\n//").where(F.col("value").rlike(r"(?m)^SQ"))
    accession, description, seq = parse_embl(F.concat(F.lit("\n"), F.col("value")))
    return raw.select(accession.alias("seq_id"), description.alias("description"), seq.alias("seq"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Files of either kind, told apart by how they begin: > for FASTA, ID for EMBL; any other is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^\s*(>|ID)", 1).alias("kind"), F.input_file_name().alias("file"))
    files = whole.collect()  # a name and two characters a file
    if bad := [r["file"] for r in files if not r["kind"]]:
        raise ValueError(f"neither FASTA nor EMBL: {bad[:5]}")
    fasta, embl = ([r["file"] for r in files if r["kind"] == kind] for kind in (">", "ID"))
    parts = [read(spark, names) for read, names in ((read_fasta, fasta), (read_embl, embl)) if names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe(sequences: DataFrame) -> DataFrame:
    """The catalogue: seq_id, description, its first line's first 60 characters, length."""
    return sequences.select("seq_id", "description", F.substring(F.substring_index("description", "\n", 1), 1, 60).alias("short"), F.length("seq").alias("length"))
