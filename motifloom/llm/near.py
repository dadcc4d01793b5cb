"""Near duplicates by bottom-k sketches from one hash function.

A text's set is that of its distinct word shingles, as 64-bit hashes; equal sets
(two 64-bit sums over the whole set, and its size) form a class with its lowest
id as representative. A representative's sketch is the k lowest hashes of its
set. Of two sets as alike as `threshold`, the sketches share `_shared_least`
values or more, so in any one order of all values they share one among the first
few of each. Those first few, values of many texts last, go into inverted lists.
Pairs of a list are estimated from the union of their sketches, and decided by it
where both sets fit into their sketches; others that the estimate doesn't rule
out are decided by their whole sets. Three rounds form the pairs:

1. each list's most listed member (its hub) with all others of the list;
2. in lists that still have several components, all pairs if they are `few`, else
   the list's members outside its main component with `pivots` of that component;
3. the texts of lists that still have several components get whole sets for
   sketches, rarest values first; places in those bound what two sets can share,
   so only pairs that can be linked are formed, and all of those are decided.

So no link between components is lost, and no list forms all its pairs.

What is left to chance, and how to take it away: two sketches of sets that don't
fit into them share less than `_shared_least` with a chance below 1e-9 a pair, and
lie `sigmas` standard deviations below their estimate with one below 1e-9 too. A
k no smaller than every set (EXACT) makes every sketch the whole set, and with it
the lists complete and each estimate exact.

Edge cases: a text of fewer words than a shingle has its whole sequence as one
shingle; one without words, or null, is linked with nothing, however many there
are; texts of any length are taken whole; equal texts are one class, ties go to
the lower id; where several rows have an id, each row has the component of its own
text, and classes with the same lowest id are one; a null id is never a component
and belongs to that of its set's other ids, if any; an empty table gives no rows;
other columns are not read, and pass through drop_near_duplicates whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..storage import discard, release
from ..storage import stored as saved
from . import words as W
from .shared import free_name, lean, small

U64 = np.uint64
_BLOCK_BYTES = 1_000_000


@dataclass(frozen=True)
class Settings:
    words: int = 5  # in a shingle
    threshold: int = 80  # per cent
    k: int = 64  # values in a sketch
    sigmas: float = 6.0  # below the threshold from where an estimate rules a pair out
    few: int = 8  # members of a list that forms all pairs
    pivots: int = 16  # of a component, for the members of longer lists
    chunk: int = 1000  # partners that a text meets in one task
    broadcast_bytes: int = 64_000_000  # that a join may send to all tasks


EXACT = Settings(k=1 << 40)


def shingles(block: W.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of a block's shingles, by row and hash."""
    h, n = block.hashes(), np.diff(block.bounds)
    g, rows, found = h, [], []
    for j in range(1, size + 1):
        if j > 1:
            g = W.pair(g[: max(len(h) - j + 1, 0)], h[j - 1 :])
        if j < size:
            short = np.flatnonzero(n == j)
            rows.append(short)
            found.append(g[block.bounds[short]])
        else:
            whole = np.flatnonzero(block.row[: len(g)] == block.row[j - 1 :]) if len(g) else np.zeros(0, np.int64)
            rows.append(block.row[whole])
            found.append(g[whole])
    row, g = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[keep], g[keep]


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _sketch(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column("text"), lower=True, block_bytes=_BLOCK_BYTES):
                row, g = shingles(b, s.words)
                n = np.bincount(row, minlength=b.rows)
                bounds = np.r_[0, np.cumsum(n)]
                sums = []
                for salt in (0x1234567, 0x89ABCDE):
                    total = np.zeros(len(g) + 1, U64)
                    np.cumsum(W.mix(g ^ U64(salt)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                low = np.arange(len(g)) - bounds[row] < s.k
                columns = [batch.column("id").slice(b.first, b.rows), pa.array(n), *(pa.array(x) for x in sums), _binary(g[low], np.minimum(n, s.k))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "sketch"])

    return run


def _flat_sketches(batch: pa.RecordBatch, name: str = "sketch") -> tuple[np.ndarray, np.ndarray]:
    """All sketches' values one after the other, and their numbers."""
    column = batch.column(name)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(U64) if data is not None and at[-1] > at[0] else np.zeros(0, U64), np.diff(at) // 8


def _shared_least(s: Settings) -> int:
    """Values that two full sketches share at least, at the threshold and but for a chance below 1e-9."""
    p = s.threshold / 100
    if s.k > 1000:  # where the normal distribution is close; one standard deviation more makes up for the rest
        return max(int(s.k * p - 7 * math.sqrt(s.k * p * (1 - p))), 1)
    term, below = (1 - p) ** s.k, 0.0
    for i in range(s.k + 1):
        below += term
        if below > 1e-9:
            return max(i, 1)
        term *= (s.k - i) / (i + 1) * p / (1 - p)
    return s.k


def _rows(values: np.ndarray, row: np.ndarray, ids: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (value, id, n) in short batches. row: of each value, in ids and n."""
    n = n.astype(np.int32)
    for at in range(0, len(values), 65_536):
        r = row[at : at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(values[at : at + 65_536].view(np.int64)), ids.take(pa.array(r)), pa.array(n[r])], ["value", "id", "n"])


def _rows_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("value", T.LongType()), T.StructField("id", kind), T.StructField("n", T.IntegerType())])


def _sketch_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, sizes = _flat_sketches(batch)
        yield from _rows(values, np.repeat(np.arange(len(batch)), sizes), batch.column("id"), np.asarray(batch.column("n")))


def _whole_sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text"), lower=True, block_bytes=_BLOCK_BYTES):
                row, g = shingles(block, s.words)
                yield from _rows(g, row, batch.column("id").slice(block.first, block.rows), np.bincount(row, minlength=block.rows))

    return run


def _after(s: Settings, whole: bool):
    """Of a set's (or sketch's) values in any one order of all, whoever is alike shares one that at least so many come after."""
    n = F.col("n")
    most = F.ceil(n * s.threshold / 100) - 1
    if not whole:
        most = F.when(n * 100 <= s.k * s.threshold, most).otherwise(_shared_least(s) - 1)  # first case: whoever is alike fits into a sketch too
    return F.when(n * (100 - s.threshold) < s.threshold, n).otherwise(most)  # too few values to have an alike but unequal set


def _listed(flat: DataFrame, after) -> DataFrame:
    """value, id, n, back, listings of those values of flat (value, id, n) that several ids have and that are early in their id's order.

    The order is by the number of ids that have a value; back: how many values of the id come after, `after` or more;
    listings: how many ids have the id's early values, summed.
    """
    counts = flat.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    last_first = Window.partitionBy("id").orderBy(F.desc("c"), F.desc("value"))
    shared = flat.join(counts, "value").withColumn("back", F.row_number().over(last_first) - 1).where(F.col("back") >= after)
    return shared.withColumn("listings", F.sum("c").over(Window.partitionBy("id"))).drop("c")


def _estimated(s: Settings):
    """Adds 1 to the pairs that their sketches show linked, 2 to those left open; the others go."""
    p = s.threshold / 100
    floor = p - s.sigmas * math.sqrt(p * (1 - p) / s.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            n = [np.asarray(batch.column(c)) for c in ("n_a", "n_b")]
            (va, ka), (vb, kb) = (_flat_sketches(batch, c) for c in ("sketch_a", "sketch_b"))
            row, values = np.repeat(np.r_[np.arange(rows), np.arange(rows)], np.r_[ka, kb]), np.r_[va, vb]
            order = np.lexsort((values, row))
            row, values = row[order], values[order]
            same = np.r_[False, (row[1:] == row[:-1]) & (values[1:] == values[:-1])]
            union = ka + kb - np.bincount(row[same], minlength=rows)
            nth = np.cumsum(~same) - np.repeat(np.cumsum(union) - union, ka + kb)  # in the pair's union, from 1
            whole = (n[0] <= s.k) & (n[1] <= s.k)
            size = np.where(whole, union, np.minimum(union, s.k))
            shared = np.bincount(row[same & (nth <= size[row])], minlength=rows)
            state = np.where(whole, 100 * shared >= s.threshold * union, 2 * (shared >= floor * size)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(state)], ["a", "b", "state"])
            yield out.filter(pa.array(state > 0))

    return run


def _exact(s: Settings):
    """The linked pairs (a, b) of rows that come by a, each a's own text (b is null) before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: list[np.ndarray] = []  # the sets of the present a: one, or several where rows repeat its id
        of, ended = None, True
        for batch in batches:
            own = np.asarray(batch.column("b").is_null())
            for block in W.blocks(batch.column("text"), lower=True, block_bytes=_BLOCK_BYTES):
                row, g = shingles(block, s.words)
                n = np.bincount(row, minlength=block.rows)
                bounds = np.r_[0, np.cumsum(n)]
                linked = np.zeros(block.rows, bool)
                at = 0
                for to in [*np.flatnonzero(own[block.first : block.first + block.rows]), block.rows]:
                    found = g[bounds[at] : bounds[to]]
                    for hub in hubs if at < to else ():
                        hit = hub[np.minimum(np.searchsorted(hub, found), len(hub) - 1)] == found
                        both = W.rows_sum(hit, bounds[at : to + 1] - bounds[at])
                        linked[at:to] |= 100 * both >= s.threshold * (n[at:to] + len(hub) - both)
                    ended |= at < to
                    if to < block.rows:
                        a = batch.column("a")[block.first + int(to)].as_py()
                        if ended or a != of:
                            hubs, of, ended = [], a, False
                        hubs.append(g[bounds[to] : bounds[to + 1]].copy())
                    at = to + 1
                columns = [batch.column(c).slice(block.first, block.rows) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"]).filter(pa.array(linked))

    return run


def _small(df: DataFrame, s: Settings) -> DataFrame:
    return small(df, s.broadcast_bytes)


def linked_pairs(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b), distinct rows, that are linked; written. sketches: id, n, sketch. docs: id, text.

    The exact step sends each text a once for `chunk` of its partners at most, before them.
    """
    kind = sketches.schema["id"].dataType
    pair = [T.StructField("a", kind), T.StructField("b", kind)]
    pairs = saved(pairs, "near-pairs")
    sized = pairs
    for end in "ab":
        sized = sized.join(sketches.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    states = sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(_estimated(s)), T.StructType([*pair, T.StructField("state", T.IntegerType())]))
    states = saved(states, "near-states")
    discard(pairs)
    sure, unsure = states.where("state = 1").select("a", "b"), states.where("state = 2").select("a", "b")
    parts = unsure.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / s.chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    partners = unsure.join(parts, "a").select(F.col("b").alias("id"), "a", part, "b")
    own = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("b"))
    wanted = saved(own.unionByName(partners), "near-wanted")
    met = docs.join(_small(wanted, s), "id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    links = saved(sure.unionByName(met.select("a", "b", "text").mapInArrow(lean(_exact(s)), T.StructType(pair))), "near-linked")
    discard(states, wanted)
    release(docs.sparkSession)
    return links


def _alike_sizes(a: str, b: str, s: Settings):
    return F.least(a, b) * 100 >= F.greatest(a, b) * s.threshold


def near_components(docs: DataFrame, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), component (lowest id reachable) of every row of docs."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["id"].dataType
    key = ["n", "d1", "d2"]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in key), T.StructField("sketch", T.BinaryType())])
    every = saved(docs.mapInArrow(lean(_sketch(s)), schema), "near-sketches")
    classes = saved(every.where("n > 0").groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "near-classes")
    small = saved(every.select("id", *key), "near-every")
    named = classes.where("id is not null")
    alone = every.join(_small(named.where("rows = 1").select("id", "d1"), s), ["id", "d1"], "left_semi").select("id", "n", "sketch")
    copied = every.drop("id").join(_small(named.where("rows > 1").select("id", *key), s), key).groupBy("id", *key).agg(F.first("sketch").alias("sketch"))
    sketches = saved(alone.unionByName(copied.select("id", "n", "sketch")), "near-reps")
    discard(every)
    release(docs.sparkSession)
    label = _components(sketches, docs, small, s)
    several = classes.join(label.withColumnRenamed("component", "low"), "id", "left").where("rows > 1 or low is not null")  # the others' component is their own id
    several = saved(several.select(*key, F.coalesce("low", "id").alias("component")), "near-named")
    discard(classes, sketches, label)
    out = small.join(_small(several, s), key, "left")
    return out.select("id", "n", F.coalesce("component", "id").alias("component"))  # sets without shingles are in no class


def _components(sketches: DataFrame, docs: DataFrame, every: DataFrame, s: Settings) -> DataFrame:
    """id, component of the linked ones among sketches (id, n, sketch) of distinct sets; written. every: id, a row for each of docs."""
    kind = docs.schema["id"].dataType
    flat = sketches.mapInArrow(lean(_sketch_values), _rows_schema(kind))
    lists = saved(_listed(flat, _after(s, whole=False)).drop("back"), "near-lists")
    release(docs.sparkSession)
    hub = lists.groupBy("value").agg(F.max_by(F.struct("id", "n"), F.struct("listings", "id")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    every_list = saved(lists.join(hub, "value"), "near-rest")
    discard(lists)
    ids = saved(every_list.select("id").distinct(), "near-ids")
    known = saved(sketches.join(_small(ids, s), "id", "left_semi"), "near-listed")
    repeated = saved(every.join(_small(ids, s), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "near-repeated")
    texts = docs
    if not repeated.isEmpty():  # their equal rows are taken once
        again = docs.join(_small(repeated, s), "id", "left_semi").dropDuplicates(["id", "text"])
        texts = docs.join(_small(repeated, s), "id", "left_anti").unionByName(again)
    discard(ids)
    release(docs.sparkSession)
    rest = every_list.where("hub.id != id")
    pairs = rest.where(_alike_sizes("hub.n", "n", s)).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    links = linked_pairs(pairs, known, texts, s)
    label = components(links)
    # a list's hub has met all others; what is left of the list has one component and is done, or is open
    placed = saved(_placed(rest.drop("hub"), label), "near-open")
    discard(every_list, label)
    few = placed.where(F.col("m") <= s.few)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & _alike_sizes("a.n", "b.n", s))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    many = placed.where(F.col("m") > s.few)
    first = Window.partitionBy("component").orderBy(F.desc("listings"), "id")
    pivots = many.where("component = main").select("id", "n", "listings", "component").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= s.pivots)
    outer = many.where("component != main").select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("main").alias("component")).distinct()
    met = outer.join(pivots.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "component"), "component").where(_alike_sizes("n_a", "n_b", s))
    links = _with(links, linked_pairs(pairs.unionByName(met.select("a", "b")).distinct(), known, texts, s))
    label = components(links)
    open_lists = saved(_placed(many.select("value", "id", "n"), label).select("id").distinct(), "near-open-ids")
    discard(placed)
    pairs = _pairs_by_whole_sets(texts.join(_small(open_lists, s), "id", "left_semi"), label, kind, s)
    more = linked_pairs(pairs, known, texts, s)
    discard(open_lists, known, repeated)
    if not more.isEmpty():
        links = _with(links, more)
        discard(label)
        label = components(links)
    discard(links)
    release(docs.sparkSession)
    return label


def _with(links: DataFrame, more: DataFrame) -> DataFrame:
    out = saved(links.unionByName(more), "near-linked")
    discard(links, more)
    return out


def _placed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """entries (value, id, ...) of values that several components have, with component, m (the value's entries) and main (its largest component)."""
    entries = entries.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = entries.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    main = F.max_by("component", F.struct("c", "component")).alias("main")
    several = each.groupBy("value").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("parts"), main).where("parts > 1").drop("parts")
    return entries.join(several, "value")


def _pairs_by_whole_sets(texts: DataFrame, label: DataFrame, kind: T.DataType, s: Settings) -> DataFrame:
    """All pairs (a, b) of texts in different components that may be linked, by lists of whole sets.

    Each set is put in order, its rarest values (among these texts) first. Two linked sets of n and m values share
    least(n, m) = threshold (n + m) / (100 + threshold) or more; if i and j are the places of their first shared value,
    then 1 + min(n - i, m - j) is at least that, so only values at such places are listed, and the sizes that a partner
    can have follow from i. Each list joins its members outside its main component, at those sizes, with all others.
    """
    t = s.threshold
    flat = saved(texts.mapInArrow(lean(_whole_sets(s)), _rows_schema(kind)), "near-sets")
    listed = saved(_listed(flat, _after(s, whole=True)).drop("listings"), "near-places")
    discard(flat)
    entries = saved(_placed(listed, label), "near-places")
    discard(listed)

    def bucket(size):  # of sizes within 5 per cent
        return F.floor(F.log(size) / math.log(1.05)).cast("int")

    least = F.ceil(F.col("n_a") * t / 100)
    most = F.floor(((100 + t) * (F.col("back_a") + 1) - t * F.col("n_a")) / t)
    a = entries.where("component != main").select("value", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("back").alias("back_a"), F.col("component").alias("c_a"))
    a = a.where(least <= most).withColumn("size", F.explode(F.sequence(bucket(least), bucket(most))))
    b = entries.select("value", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("back").alias("back_b"), F.col("component").alias("c_b"), "main", bucket(F.col("n")).alias("size"))
    enough = (1 + F.least("back_a", "back_b")) * (100 + t) >= t * (F.col("n_a") + F.col("n_b"))
    once = (F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b"))
    met = a.alias("a").join(b.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.size") == F.col("b.size")) & (F.col("c_a") != F.col("c_b")) & enough & _alike_sizes("n_a", "n_b", s) & once)
    return met.select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", by_row: bool = False) -> DataFrame:
    """docs without the rows whose component has a lower id; rows of a null id, and rows that repeat a kept id, stay.

    by_row: one row of each group of alike rows, that of the lowest id, a null one only if no other has any; rows
    without shingles all stay. Rows are told apart by a number of their own, so ids may be null or repeat.
    """
    if not by_row:
        found = near_components(docs, s, doc_id=doc_id, text=text)
        gone = saved(found.where("id != component").select("id").distinct(), "near-gone")
        gone = _small(gone.withColumnRenamed("id", "gone_"), s)
        return docs.alias("d").join(gone.alias("g"), F.col(f"d.`{doc_id}`") == F.col("g.gone_"), "left_anti")
    number, row = free_name(docs, "near_row_"), F.col("id")
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    found = near_components(rows, s, doc_id=number, text=text)
    own = rows.select(F.col(number).alias("id"), F.col(f"`{doc_id}`").alias("own"))
    found = saved(found.join(own, "id"), "near-found")
    best = F.min_by(row, F.struct(F.col("own").isNull(), "own", row)).alias("best")
    several = found.groupBy("component").agg(best, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = saved(found.join(several, "component").where("id != best").select(row.alias(number)), "near-gone")
    return rows.join(_small(gone, s), number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_components(docs, Settings(words=2))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
