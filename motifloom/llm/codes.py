"""Exact k nearest neighbours of binary codes by incremental multi-index hashing.

A vector's code is its signs. Equal codes are one entry with the k lowest ids,
which is all that any answer can use of it. The code is cut into segments, and
each segment's value indexes the distinct codes. Round r looks up, for every
query code that is still open, all values at distance r from its segments, and
verifies the whole codes found. By the pigeonhole principle every code within
distance segments * (r + 1) - 1 has then been seen, so a query is closed once its
kth verified distance is within that. A code is taken in the first round, and by
the first segment, in which it can be found, so it is verified once.

Edge cases: null vectors are in no answer and have none; a query is itself a row
and so among its own answers; ties go to the lower id; fewer than k rows give
fewer answers; components that a vector lacks count as not positive, those
beyond the code's length are left out. Rows that repeat an id are answers of their
own, as are queries that repeat one; other columns of the tables are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

BITS = 64
_PROBES_A_TASK = 500_000


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A long whose bit i is set where component i of the vector is positive; null for null."""
    set_bits = [F.when(F.get(vector, i) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    return F.when(F.col(vector).isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), set_bits))


def _segment(code: str, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _flipped(probes: DataFrame, width: int, radius: int) -> DataFrame:
    """probes, with `value` for each way to flip `radius` bits of it; bits are chosen lowest first, so each way once."""
    probes = probes.withColumn("next", F.lit(0))
    for left in range(radius - 1, -1, -1):
        probes = probes.withColumn("bit", F.explode(F.sequence("next", F.lit(width - 1 - left))))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).withColumn("next", F.col("bit") + 1).drop("bit")
    return probes.drop("next")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def segments_for(rows: int) -> int:
    """Segments about as wide as the logarithm of the number of codes, so that a value has few codes."""
    width = math.log2(max(rows, 2))
    return 8 if width < 12 else 4 if width < 24 else 2


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of each query. rows: id, code; queries: query_id, code."""
    lowest = Window.partitionBy("code").orderBy("id")
    low = rows.where("code is not null").withColumn("n_", F.row_number().over(lowest)).where(F.col("n_") <= k)
    entries = saved(low.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "code-entries")
    n = entries.count()
    segments = segments_for(n)
    width = BITS // segments
    reach = min(k, entries.agg(F.sum(F.size("ids"))).first()[0] or 0)  # answers that any query can have
    parts = F.array(*(F.struct(F.lit(s).alias("s"), _segment("code", s, width).alias("value")) for s in range(segments)))
    index = saved(entries.select(F.explode(parts).alias("p"), "code", "ids").select("p.s", "p.value", "code", "ids"), "code-index")
    asked = saved(queries.where("code is not null").select(F.col("code").alias("query")).distinct(), "code-queries")
    open_queries, best = asked.withColumn("far", F.lit(BITS)), None  # far: no code beyond can be among the k nearest
    for r in range(width + 1):
        n_open = open_queries.count()
        if not n_open:
            break
        probes = F.array(*(F.struct(F.lit(s).alias("s"), _segment("query", s, width).alias("value")) for s in range(segments)))
        probes = open_queries.select("query", "far", F.explode(probes).alias("p")).select("query", "far", "p.s", "p.value")
        if (tasks := -(-n_open * segments * math.comb(width, r) // _PROBES_A_TASK)) > 1:
            probes = probes.repartition(min(tasks, n_open * segments), "query", "s")
        probes = _flipped(probes, width, r)
        gaps = [F.bit_count(_segment("query", s, width).bitwiseXOR(_segment("code", s, width))) for s in range(segments)]
        first = F.array_position(F.array(*gaps), F.lit(r)) - 1 == F.col("s")
        # by shuffle: the planner takes the probes for as few rows as there are queries, and would broadcast them
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        met = probes.join(index.hint("merge"), ["s", "value"]).where((F.array_min(F.array(*gaps)) == r) & first & (distance <= F.col("far")))
        met = met.select("query", distance.alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            met = met.unionByName(best.select("query", "distance", "id"))
        best = saved(_best(met, k), "code-best")
        state = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        done = state.where((F.col("n") >= reach) & ((F.col("far") <= segments * (r + 1) - 1) | F.lit(reach < k)))
        left = open_queries.select("query").join(done, "query", "left_anti").join(state, "query", "left")
        open_queries = saved(left.select("query", F.when(F.col("n") >= k, F.col("far")).otherwise(BITS).alias("far")), "code-open")
    if best is None:
        best = asked.select("query", F.lit(0).alias("distance"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(0).alias("rank")).where("false")
    named = queries.where("code is not null").select("query_id", F.col("code").alias("query"))
    return named.join(best, "query").select("query_id", "rank", "id", "distance")


def op6_exact_top_k(spark, sf_dir: str, k: int = 10) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), k)


ORACLE = """
WITH signs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(q.code, r.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM signs q CROSS JOIN signs r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""
