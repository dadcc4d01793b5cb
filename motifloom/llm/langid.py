"""Language identification by character models, one interpolated modified
Kneser-Ney model a language.

A text's words (its runs of letters and other characters beyond ASCII) are
lower-cased and scored character by character, each with up to `order - 1`
characters before it, back to the blank in front of its word, and with the blank
after it. So a distinct word is scored once a block, whatever its number of
occurrences. N-grams are counted per language in each task before the shuffle;
discounts, contexts and continuation counts are DataFrame aggregates. The model
is kept as sorted hash arrays in the shared folder, with one column a language,
and memory-mapped by the workers.

The language with the lowest cross-entropy a character wins. Its confidence is
the posterior over the languages of a text of at most `evidence` characters. One
tenth of the learning texts, by a hash of the text, is left out of the models and
calibrates the rejection: a text whose cross-entropy lies above what `1 - reject` of
those of its language have is marked as rejected.

Edge cases: `und` with score 0 where the text is null or has no letter, or where
nothing could be learned; ties go to the first language by name; learning leaves
out null languages. A language all of whose texts fall into the tenth learns from
them instead; one without a text there rejects none. Rows that repeat an id or a text
are each counted and each predicted (equal texts fall on one side of the tenth).
Texts of any length are scored whole. Other columns play no part, and where a kept
one has the name of an added one, the added one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import free_name, map_array, saved, shared_dir, write_array

U64 = np.uint64
_BETWEEN = np.ones(256, bool)  # ASCII without its letters
_BETWEEN[128:] = False
_BETWEEN[65:91] = _BETWEEN[97:123] = False
_BLOCK_BYTES = 4_000_000
_FLUSH_GRAMS = 2_000_000
_ROWS_A_SHARD = 2_000_000
_LEAST_ROWS_A_SHARD = 10_000  # fewer only to have one shard


@dataclass(frozen=True)
class Model:
    path: str
    languages: tuple[str, ...]
    order: int
    shards: tuple[tuple[str, int], ...]  # of each array
    symbols: int


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(W.text_column(column))


def _chars(block: W.Block, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words at `one` with a blank around each; how far behind its blank each lies; its word."""
    s, e = block.start[one], block.end[one]
    sizes = e - s
    out = np.full(int(sizes.sum()) + len(s) + 1, 32, np.uint8)
    to = np.cumsum(sizes + 1) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + place] = block.raw[np.repeat(s, sizes) + place]
    points = np.frombuffer(out.tobytes().decode().encode("utf-32-le"), np.uint32)
    blanks = np.flatnonzero(points == 32)
    word = np.repeat(np.arange(len(s)), np.diff(blanks))  # of points 1, 2, ...
    return points, np.arange(1, len(points)) - blanks[:-1][word], word


def _grams(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each point, n = 1, 2, ... order; meaningless where n reaches too far back."""
    out = [W.mix(points.astype(U64) + U64(1))]
    for _ in range(order - 1):
        g = out[-1]
        out.append(np.r_[g[:1], W.pair(g[:-1], g[1:])])
    return out


_COUNTED = T.StructType([T.StructField(n, T.IntegerType() if n in ("lang", "n") else T.LongType()) for n in ("lang", "n", "gram", "before", "after", "bos", "c")])


def _count(languages: tuple[str, ...], order: int):
    names = _COUNTED.names
    schema = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in _COUNTED.fields])
    number = {x: i for i, x in enumerate(languages)}

    def add(held: list[np.ndarray]) -> list[np.ndarray]:
        """Rows (gram, before, after, bos, c), summed by gram."""
        rows = np.concatenate(held, axis=1)
        order_ = np.argsort(rows[0], kind="stable")
        rows = rows[:, order_]
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        c = np.add.reduceat(rows[4], first)
        rows = rows[:, first]
        rows[4] = c
        return [rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in sorted(held.items()):
                (rows,) = add(parts)
                columns = [np.full(rows.shape[1], lang, np.int32), np.full(rows.shape[1], n, np.int32), *(x.view(np.int64) for x in rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
            held.clear()

        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for block in W.blocks(_lowered(batch.column("text")), block_bytes=_BLOCK_BYTES, space=_BETWEEN):
                hashes, own = block.hashes(), which[block.first : block.first + block.rows][block.row]
                for lang in np.unique(own):
                    at = np.flatnonzero(own == lang)
                    _, one, times = np.unique(hashes[at], return_index=True, return_counts=True)
                    points, behind, word = _chars(block, at[one])
                    grams = _grams(points, order)
                    for n in range(1, order + 1):
                        i = np.flatnonzero(behind >= n - 1) + 1
                        lower = grams[n - 2] if n > 1 else np.zeros(len(points), U64)
                        rows = np.stack([grams[n - 1][i], lower[i - 1], lower[i], (behind[i - 1] == n - 1).astype(U64), times[word[i - 1]].astype(U64)])
                        held[lang, n] = held.get((lang, n), []) + add([rows])
                        if len(held[lang, n]) > 8:
                            held[lang, n] = add(held[lang, n])
            if sum(x.shape[1] for parts in held.values() for x in parts) > _FLUSH_GRAMS:
                yield from out()
        yield from out()

    assert names == schema.names
    return run


def _write(path: str, name: str, languages: int, missing: float):
    """Writes one shard: its sorted hashes, and a value of each for every language."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, shard = int(pdf["n"].iloc[0]), int(pdf["shard"].iloc[0])
        keys, at = np.unique(pdf["key"].to_numpy().view(U64), return_inverse=True)
        table = np.full((len(keys), languages), missing, np.float32)
        table[at, pdf["lang"].to_numpy()] = pdf["value"].to_numpy()
        write_array(f"{path}/{name}-{n}-key-{shard}.npy", keys)
        write_array(f"{path}/{name}-{n}-value-{shard}.npy", table)
        return pd.DataFrame({"n": [n], "keys": [len(keys)]})

    return run


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", order: int = 4) -> Model | None:
    """A model for each non-null language of docs, or None if there is none."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    languages = tuple(sorted(r["lang"] for r in docs.select("lang").distinct().toLocalIterator()))
    if not languages:
        return None
    path = shared_dir(spark, "langid")
    raw = docs.mapInArrow(_count(languages, order), _COUNTED)
    raw = saved(raw.groupBy("lang", "n", "gram", "before", "after", "bos").agg(F.sum("c").alias("c")), "langid-grams")
    follow = raw.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("after").alias("gram")).agg(F.count(F.lit(1)).alias("distinct_before"))
    adjusted = F.when((F.col("n") == order) | (F.col("bos") == 1) & (F.col("n") > 1), F.col("c")).otherwise(F.coalesce("distinct_before", F.lit(0)))
    rows = saved(raw.join(follow, ["lang", "n", "gram"], "left").select("lang", "n", "gram", "before", adjusted.alias("c")).where("c > 0"), "langid-counts")
    tally = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    discounts: dict[tuple[int, int], tuple[float, float, float]] = {(r["lang"], r["n"]): _discounts(*(r[f"n{i}"] for i in (1, 2, 3, 4))) for r in rows.groupBy("lang", "n").agg(*tally).collect()}  # languages x order rows
    by = [F.coalesce(*(F.when((F.col("lang") == a) & (F.col("n") == b), F.lit(d[i])) for (a, b), d in discounts.items())) if discounts else F.lit(0.0) for i in range(3)]
    off = F.when(F.col("c") == 1, by[0]).when(F.col("c") == 2, by[1]).otherwise(by[2])
    rows = rows.withColumn("off", F.least(off, F.col("c").cast("double")))
    contexts = rows.groupBy("lang", "n", "before").agg(F.sum("c").alias("total"), F.sum("off").alias("given"))
    contexts = saved(contexts, "langid-contexts")
    kept = rows.join(contexts, ["lang", "n", "before"]).select("lang", "n", F.col("gram").alias("key"), ((F.col("c") - F.col("off")) / F.col("total")).alias("value"))
    weight = contexts.select("lang", "n", F.col("before").alias("key"), (F.col("given") / F.col("total")).alias("value"))
    shards, symbols = [], 0
    for name, table, missing in (("gram", kept, 0.0), ("context", weight, 1.0)):
        n_rows = table.count()
        count = max(1, -(-n_rows // _ROWS_A_SHARD), min(spark.sparkContext.defaultParallelism, n_rows // _LEAST_ROWS_A_SHARD))
        wide = F.shiftrightunsigned("key", 32)
        table = table.withColumn("shard", F.shiftrightunsigned(wide * F.lit(count).cast("long"), 32))
        sizes = table.groupBy("n", "shard").applyInPandas(_write(path, name, len(languages), missing), "n int, keys long").groupBy("n").sum("keys").collect()
        shards.append((name, count))
        symbols = symbols or next((r["sum(keys)"] for r in sizes if r["n"] == 1), 0)
    return Model(path, languages, order, tuple(shards), symbols)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _lookup(model: Model, name: str, n: int, keys: np.ndarray, missing: float) -> np.ndarray:
    shards = dict(model.shards)[name]
    out = np.full((len(keys), len(model.languages)), missing, np.float32)
    rising = np.argsort(keys)
    bounds = np.searchsorted((keys[rising] >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64))
    for s in range(shards):
        at = rising[bounds[s] : bounds[s + 1]]
        own = keys[at]
        try:
            have = map_array(f"{model.path}/{name}-{n}-key-{s}.npy")
        except FileNotFoundError:  # no key fell in this shard
            continue
        place = np.minimum(np.searchsorted(have, own), len(have) - 1)
        out[at] = np.where((have[place] == own)[:, None], map_array(f"{model.path}/{name}-{n}-value-{s}.npy")[place], np.float32(missing))
    return out


def word_costs(model: Model, points: np.ndarray, behind: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """Bits of each word, and of the blank after it, in every language."""
    p = np.full((len(behind), len(model.languages)), 1.0 / (model.symbols + 1), np.float32)
    grams = _grams(points, model.order)
    for n in range(1, model.order + 1):
        i = np.flatnonzero(behind >= n - 1)
        if n == 1:
            weight = _lookup(model, "context", 1, np.zeros(1, U64), 1.0)
        else:
            weight = _lookup(model, "context", n, grams[n - 2][i], 1.0)
        p[i] = _lookup(model, "gram", n, grams[n - 1][i + 1], 0.0) + weight * p[i]
    starts = np.flatnonzero(behind == 1)
    return np.add.reduceat(-np.log2(np.maximum(p, 1e-30)).astype(np.float64), starts, axis=0) if n_words else np.zeros((0, p.shape[1]))


def _has_letter(block: W.Block) -> np.ndarray:
    ascii_letter = ~_BETWEEN[block.raw] & (block.raw < 128)
    out = W.rows_sum(ascii_letter, block.offsets) > 0
    other = W.rows_sum(block.raw >= 128, block.offsets) > 0
    for i in np.flatnonzero(~out & other):
        out[i] = any(ch.isalpha() for ch in block.raw[block.offsets[i] : block.offsets[i + 1]].tobytes().decode())
    return out


def _predict(model: Model | None, evidence: float, names: list[str]):
    """names: of all columns that come out; the last column that comes in is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, bits = [], [], []
            for block in W.blocks(_lowered(batch.column(batch.num_columns - 1)), block_bytes=_BLOCK_BYTES, space=_BETWEEN):
                fit = _has_letter(block)
                if model is None or not len(block.start):
                    langs += ["und"] * block.rows
                    scores.append(np.zeros(block.rows))
                    bits.append(np.full(block.rows, np.nan))
                    continue
                _, one, back = np.unique(block.hashes(), return_index=True, return_inverse=True)
                points, behind, word = _chars(block, one)
                costs = word_costs(model, points, behind, word, len(one))
                sizes = np.bincount(word, minlength=len(one))
                total = np.zeros((len(back) + 1, costs.shape[1]))
                np.cumsum(costs[back], axis=0, out=total[1:])
                chars = W.rows_sum(sizes[back], block.bounds)
                each = (total[block.bounds[1:]] - total[block.bounds[:-1]]) / np.maximum(chars, 1)[:, None]
                best = each.argmin(axis=1)
                low = each[np.arange(block.rows), best]
                worth = np.minimum(chars, evidence)[:, None]
                score = 1 / np.exp2(-(each - low[:, None]) * worth).sum(axis=1)
                langs += [model.languages[b] if ok else "und" for b, ok in zip(best, fit, strict=True)]
                scores.append(np.where(fit, score, 0.0))
                bits.append(np.where(fit, low, np.nan))
            if langs:
                columns = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(bits), from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], *, text: str = "text", evidence: float = 40.0) -> DataFrame:
    """keep, lang_pred, score (the winner's posterior on at most `evidence` characters) and bits (its cross-entropy a character) of each row."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    fields = [T.StructField(free_name(kept, n), kind) for n, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType()))]
    schema = T.StructType([*kept.schema.fields, *fields])
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(_predict(model, evidence, schema.names), schema)


def calibrating(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Column:
    """Which learning rows are left out of the models: a tenth by text, where their language has others."""
    tenth = F.pmod(F.xxhash64(f"`{text}`"), F.lit(10)) == 0
    others = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.bool_or(~tenth).alias("some"))
    named = [r["lang"] for r in others.where("some").toLocalIterator()]  # one row a language
    return F.coalesce(tenth & F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isin(named), F.lit(False))


def op10_language_id(spark, sf_dir: str, reject: float = 0.002) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = docs.withColumn("held_out", out)
    docs = docs.withColumn("calibrates", ~F.col("held_out") & calibrating(docs.where(~F.col("held_out"))))
    model = train(docs.where(~F.col("held_out") & ~F.col("calibrates")))
    found = saved(predict(docs, model, ["doc_id", "held_out", "calibrates"]), "langid-found")
    limits = {r["lang_pred"]: r["most"] for r in found.where(F.col("calibrates") & F.col("bits").isNotNull()).groupBy("lang_pred").agg(F.percentile_approx("bits", 1 - reject, 10_000).alias("most")).collect()}  # one row a language
    limit = F.coalesce(*(F.when(F.col("lang_pred") == x, F.lit(v)) for x, v in limits.items())) if limits else F.lit(None).cast("double")
    return found.withColumn("rejected", F.coalesce(F.col("bits") > limit, F.col("lang_pred") == "und"))
