"""Motif scan of sequences as their files arrive.

The scan keeps nothing between rows, so it runs on a stream as on a table; each
file's sequences are scanned once, by the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.scan import scan


def scanned_stream(spark: SparkSession, folder: str, weights: Mapping[str, np.ndarray], cutoffs: Mapping[str, float], background: np.ndarray | None = None) -> DataFrame:
    """Sites of the sequences (Parquet of seq_id, description, seq) that arrive in folder."""
    arriving = spark.readStream.schema(schemas.SEQUENCES).parquet(folder)
    return scan(arriving, weights, cutoffs, background)


def write_stream(sites: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends sites to Parquet; by default all that is there, then stops."""
    return sites.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
