"""Mixing documents to target domain weights by soft membership.

A classifier learned from labelled documents (hashed words, word beginnings and
word ends; softmax regression, on a bounded sample of the labelled rows) gives
every document a posterior over the domains. Document d of t_d tokens then gets a
rate r_d >= 0: accelerated projected gradient descent on

    1/2 |sum_d (t_d / S) q_d r_d - target|^2 + ridge/2 sum_d (t_d / S) (r_d - 1)^2

with S all tokens and q_d the posterior, in the metric of the tokens, so that
long documents take no larger steps. A step needs one sum over all documents, a
vector of one number a domain; a document's rate is worked out again from the
history of those vectors, so nothing is kept per document between the steps.

Edge cases: null and empty texts have no tokens, the sample's domain shares as
posterior, and their rate follows from those; without labelled rows all posteriors
are equal; an empty table gives no rows. Where labels repeat an id, its lowest
domain counts; where documents do, one of their texts (that of the lowest features)
is learned, each row gets posterior and rate of its own text, and mix() goes by the
highest rate. Long texts are taken whole. Other columns are not read, and pass
through mix() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .blob import pack, unpack
from .shared import discard, free_name, saved, small

U64 = np.uint64
#: Buckets of words, of their first five bytes, of their last two.
_BUCKETS = (1 << 17, 1 << 16, 1 << 14)
_OFFSETS = np.r_[0, np.cumsum(_BUCKETS)]


@dataclass(frozen=True)
class Settings:
    sample: int = 3000  # labelled documents that the classifier learns from, at most
    sample_bytes: int = 64_000_000  # of their features; the document that reaches it is the last
    rounds: int = 150  # of its gradient descent
    decay: float = 1e-4
    ridge: float = 0.003
    steps: int = 60  # of the fit, at most
    tolerance: float = 1e-4  # change of a domain's share at which the fit ends
    broadcast_bytes: int = 64_000_000  # that a join may send to all tasks


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray


def _features(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three bucket numbers a word."""
    out = []
    spans = ((block.start, block.end), (block.start, np.minimum(block.end, block.start + 5)), (np.maximum(block.start, block.end - 2), block.end))
    for (start, end), size, offset in zip(spans, _BUCKETS, _OFFSETS, strict=False):
        out.append((W.span_hashes(block.raw, start, end) >> U64(65 - size.bit_length())).astype(np.int64) + offset)
    return tuple(out)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.blocks(batch.column("text"), lower=True):
            features = np.stack(_features(b), axis=1)
            blobs = []
            for i in range(b.rows):
                own = features[b.bounds[i] : b.bounds[i + 1]]
                keys, counts = W.summed(own.ravel())
                blobs.append(pack(keys, counts, np.array([len(own)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(b.first, b.rows) for c in ("id", "domain")), pa.array(blobs, pa.binary())], ["id", "domain", "features"])


def learn(labelled: DataFrame, s: Settings = Settings()) -> Classifier | None:
    """labelled: id, text, domain, any number of rows for each of s.sample ids at most. None without rows."""
    kept = labelled.where("domain is not null and text is not null").select("id", "text", "domain")
    schema = T.StructType([kept.schema["id"], T.StructField("domain", T.StringType()), T.StructField("features", T.BinaryType())])
    each = saved(kept.mapInArrow(_sampled, schema).groupBy("id", "domain").agg(F.min("features").alias("features")), "mixing-sample")
    size = F.octet_length("features")
    before = F.sum("size").over(Window.orderBy("order", "id")) - F.col("size")  # over s.sample short rows
    taken = each.select("id", size.alias("size"), F.xxhash64("id").alias("order")).withColumn("before", before).where(F.col("before") < s.sample_bytes)
    rows = each.join(F.broadcast(taken.select("id")), "id").collect()
    discard(each)
    rows.sort(key=lambda r: r["id"])
    if not rows:
        return None
    domains = tuple(sorted({r["domain"] for r in rows}))
    target = np.array([domains.index(r["domain"]) for r in rows])
    parts = [unpack(r["features"]) for r in rows]
    sizes = np.array([len(p[0]) for p in parts])
    parts = [p for p in parts if len(p[0])]
    target, sizes = target[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return Classifier(domains, np.zeros((_OFFSETS[-1], len(domains)), np.float32), np.zeros(len(domains)))
    keys, column = np.unique(np.concatenate([p[0] for p in parts]).astype(np.int64), return_inverse=True)
    values = np.concatenate([p[1] / max(int(p[2][0]), 1) for p in parts]) * 10
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    k = len(domains)
    w, bias, seen = np.zeros((len(keys), k)), np.log(np.bincount(target, minlength=k) / len(target)), np.full((len(keys), k), 1e-8)
    for _ in range(s.rounds):
        logits = np.add.reduceat(w[column] * values[:, None], starts, axis=0) + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        p /= len(p)
        grad = np.stack([np.bincount(column, values * p[doc, j], len(keys)) for j in range(k)], axis=1) + s.decay / len(p) * w
        seen += grad * grad
        w -= 0.7 * grad / np.sqrt(seen)
        bias -= 1.0 * p.sum(axis=0)
    weights = np.zeros((_OFFSETS[-1], k), np.float32)
    weights[keys] = w * 10
    return Classifier(domains, weights, bias)


def posteriors(docs: DataFrame, classifier: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """keep, tokens and q (a posterior for each domain) of each row."""
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("text"))
    added = [T.StructField("tokens", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([f for f in source.schema.fields if f.name != "text"] + added)
    shared = source.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for b in W.blocks(batch.column("text"), lower=True):
                n = np.diff(b.bounds)
                total = np.zeros((len(b.start) + 1, weights.shape[1]))
                np.cumsum(sum(weights[f].astype(np.float64) for f in _features(b)), axis=0, out=total[1:])
                logits = (total[b.bounds[1:]] - total[b.bounds[:-1]]) / np.maximum(n, 1)[:, None] + bias
                q = np.exp(logits - logits.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.rows + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
                kept = [batch.column(f"k{i}").slice(b.first, b.rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), lists], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _step_size(s: Settings) -> float:
    return 1 / (1 + s.ridge)  # the largest curvature, in the tokens' metric, is 1 + ridge at most


def rates_of(q: np.ndarray, history: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """After the steps of history (residual vectors at the looked-ahead rates): the rates, and the rates looked ahead to."""
    r = ahead = np.ones(len(q))
    t = 1.0
    for e in history:
        new = np.maximum(0.0, ahead - _step_size(s) * (q @ e + s.ridge * (ahead - 1)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, ahead, t = new, new + (t - 1) / t_new * (new - r), t_new
    return r, ahead


def _table(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("tokens")).astype(float), np.asarray(batch.column("q").flatten()).reshape(-1, k)


def fit(soft: DataFrame, target: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """The history of residual vectors, one a step, whose last rates give the expected domain totals nearest to target (shares of all tokens)."""
    k, history = len(target), np.zeros((0, len(target)))
    sums = "array<double>"
    soft = soft.select("tokens", "q")
    total = soft.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return history
    before = None
    for _ in range(s.steps):

        def run(batches: Iterator[pa.RecordBatch], history=history) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * k)
            for batch in batches:
                t, q = _table(batch, k)
                r, ahead = rates_of(q, history, s)
                out += np.r_[(t * ahead) @ q, (t * r) @ q]
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["x"])

        parts = soft.mapInArrow(run, f"x {sums}").agg(*(F.sum(F.col("x")[i]) for i in range(2 * k))).first()
        got = np.array(parts, float) / total
        history = np.vstack([history, got[:k] - target])
        if before is not None and np.abs(got[k:] - before).max() < s.tolerance:
            break
        before = got[k:]
    return history


def with_rates(soft: DataFrame, history: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """soft and the rate of each row."""
    names, k = [*soft.columns, "rate"], history.shape[1]
    plain = soft.toDF(*(c if c in ("tokens", "q") else f"k{i}" for i, c in enumerate(soft.columns)))  # names that need no quotes
    schema = T.StructType([*plain.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = rates_of(_table(batch, k)[1], history, s)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], schema.names)

    return plain.mapInArrow(run, schema).toDF(*names)


def copies(rate: Column, *key: Column, whole_from: float | None = None) -> Column:
    """A number of copies whose mean over keys is rate; from the rate whole_from on at least one."""
    u = F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)
    n = F.floor(rate + u).cast("int")
    return n if whole_from is None else F.when(rate >= whole_from, F.greatest(n, F.lit(1))).otherwise(n)


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when((F.col(toxic) == 0) & (F.col(quality) == 1), "clean")


#: Shares of the mixture's tokens, of as many tokens as there are.
TARGET = {"clean": 0.96, "low": 0.04, "toxic": 0.0}


def soft_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, tokens, q of every row, and the domains of q. labels: doc_id, domain."""
    chosen = labels.where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    sample = sample.select(F.col("doc_id").alias("labelled_"), "domain")
    pairs = docs.select(F.col(f"`{doc_id}`").alias("id_"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), F.col("id_") == F.col("labelled_"))
    classifier = learn(pairs.select(F.col("labelled_").alias("id"), "text", "domain"), s)
    if classifier is None:
        classifier = Classifier(tuple(sorted(TARGET)), np.zeros((_OFFSETS[-1], len(TARGET)), np.float32), np.zeros(len(TARGET)))
    return saved(posteriors(docs, classifier, [doc_id], text), "mixing-soft"), classifier.domains


def mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, tokens, q, rate of every row, and the domains of q."""
    soft, domains = soft_documents(docs, labels, s, doc_id=doc_id, text=text)
    history = fit(soft, np.array([target.get(d, 0.0) for d in domains]), s)
    return with_rates(soft, history, s), domains


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text", whole_from: float = 0.5) -> DataFrame:
    """The rows of docs, each as often as its rate says; doc_id is taken to be distinct (rows that share one go by the highest rate)."""
    rated, _ = mixed(docs, labels, target, s, doc_id=doc_id, text=text)
    plan = saved(rated.groupBy(F.col(f"`{doc_id}`").alias("mixed_")).agg(F.max("rate").alias("rate")).select("mixed_", copies(F.col("rate"), F.col("mixed_"), whole_from=whole_from).alias("n_")).where("n_ != 1"), "mixing-plan")
    rows = docs.alias("d").join(small(plan, s.broadcast_bytes).alias("m"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("m.mixed_")), "left")
    n = F.coalesce("m.n_", F.lit(1))
    times = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    copy = free_name(docs, "copy")
    return rows.select("d.*", F.explode(times).alias(copy)).drop(copy)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain().alias("domain"))
    out, domains = mixed(docs, labels)
    share = [F.col("q")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), *share, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
