"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as
sorted hash arrays in the shared folder, memory-mapped by the workers that score.

Tokens are the words of a lower-cased (A-Z) text and one end; a begin mark is a
context only. Words are known by 64-bit hashes and bigrams by a 64-bit hash of
two. Counting pre-aggregates in each task and moves packed arrays, one blob a
task and shard. Bigrams are dealt by their first word, so that its context sums
are complete in one shard; those of the words that hold over a quarter of a
shard's share of all tokens are dealt by the whole bigram instead and their sums
added up afterwards, at most four words a shard.

p(w | v) = (c(vw) - D(c)) / c(v) + g(v) * p(w)
p(w)     = (t(w) - D(t)) / T + g * 1 / (V + 1)
c: bigram counts; t(w): distinct words before w; T: their sum; V: distinct
tokens. D: the three modified discounts of each order, from its counts of
counts. An unseen context leaves p(w); an unseen word has its share of the
uniform part.

Edge cases: a null text is an empty one (its only token is the end); a null id
counts as the empty string in the split; an empty training part gives p(w) = 1.
Columns other than those named are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .blob import pack, unpack
from .shared import map_array, saved, shared_dir, write_array

U64 = np.uint64
BEGIN, END = (W.mix(np.array([x], U64))[0] for x in (0xB0B0B0, 0xE0E0E0))
#: Tokens that a task gathers before it sums them up and sends them on.
FLUSH_TOKENS = 4_000_000


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    path: str
    shards: int
    tokens: int
    types: int
    cont_total: int
    discounts: tuple[tuple[float, ...], tuple[float, ...]]  # of words, of bigrams
    word_gamma: float
    heavy: tuple[tuple[int, int, int, int, int], ...]  # hash, total, n1, n2, n3

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def held_out(doc_id: str, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def _sequence(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with a begin and an end for each row; where each row's begin is (and one past the last)."""
    seq = np.empty(len(block.start) + 2 * block.rows, U64)
    at = block.bounds + 2 * np.arange(block.rows + 1)
    seq[np.arange(len(block.start)) + 2 * block.row + 1] = block.hashes()
    seq[at[:-1]] = BEGIN
    seq[at[1:] - 1] = END
    return seq, at


def _range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _gram_shard(first: np.ndarray, gram: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """The shard of each bigram: by its first word, or by all of it where that word is heavy."""
    by = W.mix(first)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, first), len(heavy) - 1)
        by = np.where(heavy[at] == first, gram, by)
    return _range_shard(by, shards)


def _by_shard(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard.astype(np.uint16 if shards < 65536 else np.int64), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        yield int(s), [a[own] for a in arrays]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_BLOB = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "kind string, shard int, blob binary"


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = W.summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            rows = [("word", s, pack(k, c)) for s, (k, c) in _by_shard(_range_shard(keys, shards), shards, keys, counts)]
            held.clear()
            return _rows(rows, _BLOB)

        for batch in batches:
            for block in W.blocks(batch.column("text"), lower=True):
                held.append(W.summed(np.r_[block.hashes(), np.full(block.rows, END, U64)]))
                size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _sum_words(top: int):
    """One row a shard: its summed words, token and type counts, and its most frequent words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in pdf["blob"]]
        keys, counts = W.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        best = np.sort(np.argsort(-counts, kind="stable")[:top])
        return pd.DataFrame({"kind": ["word"], "shard": pdf["shard"].iloc[:1].to_numpy(), "blob": [pack(keys, counts)], "tokens": [int(counts.sum())], "types": [len(keys)], "top": [pack(keys[best], counts[best])]})

    return run


def _count_pairs(shards: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            first, second = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            gram = W.pair(first, second)
            order = np.argsort(gram)
            gram = gram[order]
            at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            counts = np.diff(np.r_[at, len(gram)])
            first, second, gram = first[order[at]], second[order[at]], gram[at]
            rows = []
            for s, (a, b, c) in _by_shard(_gram_shard(first, gram, shards, heavy), shards, first, second, counts):
                firsts, a_at = np.unique(a, return_inverse=True)
                seconds, b_at = np.unique(b, return_inverse=True)
                own = np.argsort(a_at * len(seconds) + b_at)
                rows.append(("pair", s, pack(firsts, seconds, np.diff(a_at[own], prepend=0), b_at[own], c[own])))
            return _rows(rows, _BLOB)

        for batch in batches:
            for block in W.blocks(batch.column("text"), lower=True):
                seq, at = _sequence(block)
                keep = np.ones(len(seq), bool)
                keep[at[1:] - 1] = False  # no bigram starts at an end
                firsts = np.flatnonzero(keep)
                held.append((seq[firsts], seq[firsts + 1]))
                size += len(firsts)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _counts_of(a: np.ndarray) -> list[int]:
    return [int((a == i).sum()) for i in (1, 2, 3, 4)]


def _context_sums(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(first, kind="stable")
    first, counts = first[order], counts[order]
    at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts >= 3)]
    return first[at], *sums


def _sum_pairs(path: str, shards: int, heavy: np.ndarray):
    """Writes a shard's bigram arrays; returns its context sums and, by word shard, the distinct words before each word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        first, second, counts = [], [], []
        for b in pdf["blob"]:
            firsts, seconds, a_step, b_at, c = unpack(b)
            first.append(firsts[np.cumsum(a_step.astype(np.int64))])
            second.append(seconds[b_at.astype(np.int64)])
            counts.append(c.astype(np.int64))
        first, second, counts = (np.concatenate(x) for x in (first, second, counts))
        gram = W.pair(first, second)
        order = np.argsort(gram)
        gram, counts = gram[order], counts[order]
        at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        counts = np.add.reduceat(counts, at)
        first, second, gram = first[order[at]], second[order[at]], gram[at]
        write_array(f"{path}/pair-key-{shard}.npy", gram)
        write_array(f"{path}/pair-count-{shard}.npy", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
        context = _context_sums(first, counts)
        is_heavy = np.isin(context[0], heavy)
        rows = [("heavy", -1, pack(*(x[is_heavy] for x in context)))]
        rows += [("context", s, pack(*x)) for s, x in _by_shard(_range_shard(context[0], shards), shards, *context)]
        before = W.summed(second)
        rows += [("before", s, pack(*x)) for s, x in _by_shard(_range_shard(before[0], shards), shards, *before)]
        out = pd.DataFrame(rows, columns=["kind", "shard", "blob"])
        out["counts"] = [_counts_of(counts) if i == 0 else None for i in range(len(rows))]
        return out

    return run


def _join_words(path: str):
    """Writes a shard's word arrays: count, words before, and the sums as a context."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        parts = {kind: [unpack(b) for b in own] for kind, own in pdf.groupby("kind")["blob"]}
        keys = np.unique(np.concatenate([p[0] for own in parts.values() for p in own]))
        table = np.zeros((len(keys), 6), np.int64)
        for kind, columns in (("word", [0]), ("before", [1]), ("context", [2, 3, 4, 5])):
            for p in parts.get(kind, []):
                at = np.searchsorted(keys, p[0])
                for column, values in zip(columns, p[1:], strict=True):
                    table[at, column] += values.astype(np.int64)
        write_array(f"{path}/word-key-{shard}.npy", keys)
        write_array(f"{path}/word-sums-{shard}.npy", table)
        before = table[:, 1]
        return pd.DataFrame({"total": [int(before.sum())], "counts": [[*_counts_of(before), int((before >= 3).sum())]]})

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts; where a count of counts is zero, a half, one and one and a half."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(docs: DataFrame, *, text: str = "text", shards: int | None = None) -> Model:
    """A model of all the texts of docs. shards: by default as many as docs has input partitions, 8 at least."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    shards = shards or max(8, docs.rdd.getNumPartitions())
    path = shared_dir(spark, "lm")
    counted = docs.mapInArrow(_count_words(shards), _BLOB_SQL).groupBy("shard")
    of_words = saved(counted.applyInPandas(_sum_words(4 * shards), _BLOB_SQL + ", tokens long, types long, top binary"), "lm-words")
    tokens, types = of_words.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0
    tops = [unpack(r["top"]) for r in of_words.select("top").toLocalIterator()]
    heavy = np.array(sorted(int(k) for keys, counts in tops for k, c in zip(keys, counts, strict=True) if c * 4 * shards > tokens), U64)
    heavy = np.union1d(heavy, np.array([BEGIN], U64))
    paired = docs.mapInArrow(_count_pairs(shards, heavy), _BLOB_SQL).groupBy("shard")
    of_pairs = saved(paired.applyInPandas(_sum_pairs(path, shards, heavy), _BLOB_SQL + ", counts array<long>"), "lm-pairs")
    pair_counts = [sum(x) for x in zip(*(r["counts"] for r in of_pairs.where("counts is not null").select("counts").toLocalIterator()), strict=True)] or [0] * 4
    sums: dict[int, list[int]] = {}
    for r in of_pairs.where("kind = 'heavy'").select("blob").toLocalIterator():
        for key, *values in zip(*unpack(r["blob"]), strict=True):
            sums[int(key)] = [a + int(b) for a, b in zip(sums.get(int(key), [0] * 4), values, strict=True)]
    joined = of_words.select("kind", "shard", "blob").unionByName(of_pairs.where("kind != 'heavy'").select("kind", "shard", "blob"))
    word_rows = joined.groupBy("shard").applyInPandas(_join_words(path), "total long, counts array<long>").collect()  # one row a shard
    total = sum(r["total"] for r in word_rows)
    n = [sum(r["counts"][i] for r in word_rows) for i in range(5)]
    of_word = _discounts(*n[:4])
    gamma = (of_word[0] * n[0] + of_word[1] * n[1] + of_word[2] * n[4]) / total if total else 1.0
    return Model(path, shards, tokens, types, total, (of_word, _discounts(*pair_counts)), gamma, tuple((k, *v) for k, v in sorted(sums.items())))


def _lookup(path: str, name: str, value: str, keys: np.ndarray, shard: np.ndarray, shards: int, width: int) -> np.ndarray:
    """The values of sorted distinct keys, zeros for the unknown."""
    out = np.zeros((len(keys), width), np.int64)
    for s, (own, at) in _by_shard(shard, shards, keys, np.arange(len(keys))):
        try:
            have = map_array(f"{path}/{name}-key-{s}.npy")
        except FileNotFoundError:  # no key fell in this shard
            continue
        place = np.minimum(np.searchsorted(have, own), len(have) - 1)
        hit = have[place] == own
        out[at[hit]] = map_array(f"{path}/{name}-{value}-{s}.npy")[place[hit]].reshape(-1, width)
    return out


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.array([h[0] for h in model.heavy], U64)
        heavy_sums = np.array([h[1:] for h in model.heavy], np.int64).reshape(-1, 4)
        of_word, of_pair = (np.array([0.0, *d]) for d in model.discounts)
        uniform = model.word_gamma / (model.types + 1)
        base = model.tokens + model.types + 1
        for batch in batches:
            outs: list[list[np.ndarray]] = [[], [], [], []]
            for block in W.blocks(batch.column("text"), lower=True):
                seq, at = _sequence(block)
                words, back = np.unique(seq, return_inverse=True)
                sums = _lookup(model.path, "word", "sums", words, _range_shard(words, model.shards), model.shards, 6)
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
                    is_heavy = heavy[place] == words
                    sums[is_heavy, 2:] = heavy_sums[place[is_heavy]]
                before = sums[:, 1]
                p_word = np.maximum(before - of_word[np.minimum(before, 3)], 0) / max(model.cont_total, 1) + uniform
                weight = np.divide(sums[:, 3:] @ of_pair[1:], sums[:, 2], out=np.ones(len(words)), where=sums[:, 2] > 0)
                keep = np.ones(len(seq), bool)
                keep[at[:-1]] = False
                token = np.flatnonzero(keep)
                first, second = back[token - 1], back[token]
                gram = W.pair(words[first], words[second])
                grams, one, again = np.unique(gram, return_index=True, return_inverse=True)
                shard = _gram_shard(words[first[one]], grams, model.shards, np.sort(heavy))
                count = _lookup(model.path, "pair", "count", grams, shard, model.shards, 1)[:, 0]
                total = np.maximum(sums[first[one], 2], 1)
                p = np.maximum(count - of_pair[np.minimum(count, 3)], 0) / total + weight[first[one]] * p_word[second[one]]
                starts = at[:-1] - np.arange(block.rows)  # of rows among the tokens without begins
                known = sums[second, 0]
                outs[0].append(np.diff(np.r_[starts, len(token)]))
                outs[1].append(np.add.reduceat((known > 0).astype(np.int64), starts))
                outs[2].append(np.add.reduceat(np.log10((sums[:, 0] + 1) / base)[second], starts))
                outs[3].append(np.add.reduceat(np.log10(p)[again], starts))
            if outs[0]:
                columns = [pa.array(np.concatenate(x)) for x in outs]
                kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
                names = [f.name for f in batch.schema if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (both log10) and perplexity of each row, from its whole text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out("doc_id")))
    return score(docs, model).withColumns({"held_out": held_out("doc_id"), "train_tokens": F.lit(model.tokens).cast("long")})
