"""The library's tables derived from the driver's, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.motifs import motifs_of

#: Counts of the queries' motifs: rows A, C, G, T.
MATRICES = {
    "M1": [[10, 0, 2, 0], [0, 9, 1, 1], [1, 0, 8, 0], [0, 2, 0, 10]],
    "M2": [[0, 8, 7, 1, 0], [9, 0, 1, 0, 2], [0, 1, 1, 9, 0], [1, 1, 1, 0, 8]],
    "M3": [[6, 0, 5, 0, 7, 1], [1, 5, 1, 1, 0, 1], [1, 4, 2, 8, 1, 0], [2, 1, 2, 1, 2, 8]],
}
#: Widths of the events' types as motifs.
WIDTHS = {"click": 6, "error": 8, "purchase": 10, "signup": 7, "view": 12}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases among the letters of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seq = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "acgt", "ACGT"), "[^ACGT]", "")
    return docs.select(F.col("doc_id").cast("string").alias("seq_id"), F.lit("").alias("description"), seq.alias("seq"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an N for every other letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seq = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "acgt", "ACGT"), "[^ACGT]", "N")
    return docs.select(F.col("doc_id").cast("string").alias("seq_id"), F.lit("").alias("description"), seq.alias("seq"))


def motifs(spark: SparkSession) -> DataFrame:
    return motifs_of(spark, MATRICES)


def sites(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Events as sites: a user is a sequence, a type a motif, a minute a letter. keep: further columns of the events."""
    width = F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair))
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    minute = F.floor(F.unix_seconds("ts") / 60) - 28401120
    begin = minute.cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("seq"), F.col("event_type").alias("motif"), begin.alias("begin"), (begin + width[F.col("event_type")] - 1).alias("end"),
        F.col("value").alias("score"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), *keep,
    )


SEQUENCES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS seq_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents"
MASKED_SQL = "SELECT CAST(doc_id AS VARCHAR) AS seq_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents"
MOTIFS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {j}, '{'ACGT'[i]}', CAST({c} AS DOUBLE))" for m, rows in MATRICES.items() for i, row in enumerate(rows) for j, c in enumerate(row)) + ") AS t(motif, pos, base, count)"
SITES_SQL = (
    "SELECT CAST(user_id AS VARCHAR) AS seq, event_type AS motif, CAST(floor(epoch(ts) / 60) - 28401120 AS INTEGER) AS begin_, "
    "CAST(floor(epoch(ts) / 60) - 28401120 + CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WIDTHS.items()) + " END - 1 AS INTEGER) AS end_, "
    "value AS score, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events"
)
WEIGHTS_SQL = (
    f"SELECT motif, pos, base, count, (count + 0.25) / (sum(count) OVER (PARTITION BY motif, pos) + 1) AS freq, "
    f"log2(((count + 0.25) / (sum(count) OVER (PARTITION BY motif, pos) + 1)) / 0.25) AS weight FROM ({MOTIFS_SQL})"
)
