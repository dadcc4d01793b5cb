"""Quality rules with thresholds that follow the corpus.

Counts are taken from each whole text in one vectorised pass. For every language
and source, mergeable quantile sketches (counts of logarithmic buckets, so
merging is adding) describe four measures of the texts that pass the base rule.
A limit comes from a group's sketch in two steps. A fence, `width` times the
distance from the median to the 0.7 quantile beyond that quantile, parts the bulk
from the rest, so that three tenths of a group may be junk; the limit then lies
beyond the 0.99 quantile of the bulk, by `tail` times its distance from the median.
(Low sides: 0.3 and 0.01.) A distance of zero, as where nearly all texts have no
symbols, is replaced by the rule's floor; nothing else is fixed. Groups of fewer
than `least` texts borrow their language's sketch, then that of all texts. The
verdicts come from a join of texts and thresholds on language and source.

Edge cases: a null or empty text has no words and fails the base rule; texts of
any length are counted whole; a measure equal to its limit passes; every row is
judged and counted by itself, so repeated rows and ids all stay or all go; null
languages and sources are groups of their own; an empty table gives no rows;
columns of any name pass through filter_quality unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import free_name, lean, saved

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """A measure made of two counts. floor: stands for a distance of zero; low: also reject what lies below."""

    over: str
    under: str
    floor: float
    low: bool = False


RULES = {
    "word_length": Rule("word_chars", "n_words", 0.4, low=True),
    "symbols": Rule("n_symbols", "n_words", 0.02),
    "repeated_lines": Rule("n_dup_lines", "n_lines", 0.06),
    "repeated_words": Rule("n_repeat_words", "n_words", 0.06),
}


@dataclass(frozen=True)
class Settings:
    width: float = 6.0  # distances from the 0.7 quantile to the fence around the bulk
    tail: float = 3.0  # distances from the bulk's 0.99 quantile to the limit
    least: int = 100  # texts that a group needs for a sketch of its own
    accuracy: float = 0.01  # relative error of a quantile
    broadcast_groups: int = 50_000  # beyond so many groups the join shuffles instead


def _block_counts(block: W.Block) -> list[np.ndarray]:
    raw, own, rows = block.raw, block.offsets, block.rows
    solid = ~W.SPACE[raw]
    n_words = np.diff(block.bounds)
    chars = W.rows_sum(solid & ((raw & 0xC0) != 0x80), own)
    symbols = W.rows_sum(_SYMBOL[raw], own)
    breaks = np.flatnonzero(raw == 10)
    begin, end = np.sort(np.r_[own[:-1], breaks + 1]), np.sort(np.r_[breaks, own[1:]])
    seen = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=seen[1:])
    full = seen[end] > seen[begin]
    begin, end = begin[full], end[full]
    line_row = np.searchsorted(own, begin, "right") - 1
    lines = np.bincount(line_row, minlength=rows)
    _, first = np.unique(W.pair(W.span_hashes(raw, begin, end), line_row.astype(np.uint64)), return_index=True)
    repeated_lines = lines - np.bincount(line_row[first], minlength=rows)
    covered = np.zeros(len(block.start), bool)
    if len(block.start) > 2:
        h = block.hashes()
        whole = np.flatnonzero(block.row[:-2] == block.row[2:])
        key = W.pair(W.pair(h[whole], h[whole + 1]), h[whole + 2]) + block.row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        at = whole[order[twice]] if len(whole) else whole
        for k in range(3):
            covered[at + k] = True
    return [n_words, chars, symbols, lines, repeated_lines, W.rows_sum(covered, block.bounds)]


def with_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs and one more column, a struct of COUNTS."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names of any kind go in and come out again
    at = docs.columns.index(text)
    plain = docs.toDF(*own)
    schema = T.StructType([*plain.schema.fields, T.StructField("counts", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_block_counts(b) for b in W.blocks(batch.column(at))]
            if parts:
                counts = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(counts, list(COUNTS))], [*own, "counts"])

    return plain.mapInArrow(lean(run), schema).toDF(*docs.columns, name)


def base_failed(counts: str = "") -> Column:
    n, repeated = (F.col(f"{counts}.{c}" if counts else c) for c in ("n_words", "n_repeat_words"))
    return (n < 50) | (100 * repeated > 50 * n)


def _measure(rule: Rule, counts: str) -> Column:
    over, under = (F.col(f"{counts}.{c}" if counts else c) for c in (rule.over, rule.under))
    return over / F.greatest(under, F.lit(1))


def thresholds(counted: DataFrame, by: tuple[str, str], counts: str = "", settings: Settings = Settings()) -> DataFrame:
    """One row a language and source: g_0, g_1 (their values), and low_R and high_R of each rule R."""
    gamma = (1 + settings.accuracy) / (1 - settings.accuracy)
    measures = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), _measure(rule, counts).alias("x")) for name, rule in RULES.items())))
    good = counted.where(~base_failed(counts)).select(F.col(f"`{by[0]}`").alias("g_0"), F.col(f"`{by[1]}`").alias("g_1"), measures.alias("m"))
    bucket = F.when(F.col("m.x") > 1e-9, F.ceil(F.log("m.x") / math.log(gamma)).cast("int"))
    sketch = good.groupBy("g_0", "g_1", F.col("m.rule").alias("rule"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sketch = saved(sketch, "quality-sketch")
    groups = saved(counted.select(F.col(f"`{by[0]}`").alias("g_0"), F.col(f"`{by[1]}`").alias("g_1")).distinct(), "quality-groups")

    floor = F.create_map(*(F.lit(x) for name, rule in RULES.items() for x in (name, rule.floor)))[F.col("rule")]

    def limits(level: int) -> DataFrame:
        """The keys of a level, rule, n, low and high."""
        keys = ["g_0", "g_1"][:level]
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        every = Window.partitionBy(*keys, "rule")
        upwards = every.orderBy(F.col("bucket").asc_nulls_first())
        value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
        ranked = merged.withColumns({"value": value, "below": F.sum("n").over(upwards), "all": F.sum("n").over(every)})
        ranked = ranked.withColumns({f"q{round(100 * q)}": F.min(F.when(F.col("below") >= q * F.col("all"), F.col("value"))).over(every) for q in (0.3, 0.5, 0.7)})

        def beyond(side: str, times: float):
            distance = F.abs(F.col(side) - F.col("q50"))
            return times * F.when(distance > 0, distance).otherwise(floor)

        bulk = F.col("value").between(F.col("q30") - beyond("q30", settings.width), F.col("q70") + beyond("q70", settings.width))
        ranked = ranked.withColumn("bulk", F.when(bulk, F.col("n")).otherwise(0))
        ranked = ranked.withColumns({"below": F.sum("bulk").over(upwards), "inside": F.sum("bulk").over(every)})
        ends = [F.min(F.when(F.col("below") >= q * F.col("inside"), F.col("value"))).alias(f"q{round(100 * q)}") for q in (0.01, 0.99)]
        found = ranked.groupBy(*keys, "rule").agg(F.max("all").alias("n"), F.max("q50").alias("q50"), *ends)
        return found.select(*keys, "rule", "n", (F.col("q1") - beyond("q1", settings.tail)).alias("low"), (F.col("q99") + beyond("q99", settings.tail)).alias("high"))

    wide = groups
    for level in (2, 1, 0):
        found = limits(level)
        if level:
            found = found.where(F.col("n") >= settings.least)
        ends = [F.max(F.when((F.col("rule") == name) & (rule.low or side == "high"), F.col(side))).alias(f"{side}_{name}_{level}") for name, rule in RULES.items() for side in ("low", "high")]
        table = found.groupBy(*["g_0", "g_1"][:level]).agg(*ends)
        if level:
            table = table.withColumnsRenamed({f"g_{i}": f"k_{i}" for i in range(level)})
            match = F.lit(True)
            for i in range(level):
                match &= F.col(f"g_{i}").eqNullSafe(F.col(f"k_{i}"))
            wide = wide.join(table, match, "left").drop("k_0", "k_1")
        else:
            overall = table.first()  # one row of a few numbers
            wide = wide.withColumns({c: F.lit(overall[c]).cast("double") for c in table.columns})
    chosen = [F.coalesce(*(F.col(f"{side}_{name}_{level}") for level in (2, 1, 0))).alias(f"{side}_{name}") for name in RULES for side in ("low", "high")]
    return wide.select("g_0", "g_1", *chosen)


def judged_table(counted: DataFrame, by: tuple[str, str], counts: str, settings: Settings) -> DataFrame:
    """The thresholds as g_0, g_1 and a struct; broadcast if the number of groups is within its bound."""
    table = saved(thresholds(counted, by, counts, settings), "quality-thresholds")
    limits = F.struct(*(c for c in table.columns if c[:2] != "g_")).alias("limits")
    table = table.select("g_0", "g_1", limits)
    return F.broadcast(table) if table.count() <= settings.broadcast_groups else table


def _apply(counted: DataFrame, table: DataFrame, by: tuple[str, str], counts: str, name: str) -> DataFrame:
    rows, table = counted.alias("r"), table.alias("t")
    match = F.col(f"r.`{by[0]}`").eqNullSafe(F.col("t.g_0")) & F.col(f"r.`{by[1]}`").eqNullSafe(F.col("t.g_1"))
    at = f"r.{counts}" if counts else "r"
    fails = [F.when(base_failed(at), "base")]
    for rule_name, rule in RULES.items():
        x = _measure(rule, at)
        beyond = F.coalesce(x > F.col(f"t.limits.high_{rule_name}"), F.lit(False)) | F.coalesce(x < F.col(f"t.limits.low_{rule_name}"), F.lit(False))
        fails.append(F.when(beyond, rule_name))
    return rows.join(table, match, "left").select("r.*", F.concat_ws(",", *fails).alias(name))


def judged(counted: DataFrame, by: tuple[str, str], name: str, counts: str = "", settings: Settings = Settings()) -> DataFrame:
    """counted, and a column called name: the rules that each row fails, comma-joined."""
    return _apply(counted, judged_table(counted, by, counts, settings), by, counts, name)


def filter_quality(docs: DataFrame, *, text: str = "text", by: tuple[str, str] = ("lang", "source"), settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that fail no rule, with the columns of docs."""
    counts, failed = free_name(docs, "quality_counts"), free_name(docs, "quality_failed")
    needed = [F.col(f"`{c}`") for c in dict.fromkeys((text, *by))]
    counted = with_counts(docs.select(*needed), text, counts).select(*(F.col(f"`{c}`") for c in (*by, counts)))
    counted = saved(counted, "quality-counts")
    table = judged_table(counted, by, counts, settings)
    full = with_counts(docs, text, counts)
    return _apply(full, table, by, counts, failed).where(F.col(failed) == "").select(*(f"`{c}`" for c in docs.columns))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = saved(with_counts(docs, "text", "c").select("doc_id", "lang", "source", "c.*"), "quality-counts")
    out = judged(counted, ("lang", "source"), "failed_rules")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (F.col("failed_rules") == "").alias("kept"), "failed_rules")
