"""Token counts by a two-tier look-up on the map side; no pre-token is shuffled.

The tokenizer is a byte-level BPE, which never merges over the edge of a
pre-token, so a text's count is the sum of its pre-tokens' counts. A first pass
keeps the most frequent pre-tokens of each task (a bounded summary: at `capacity`
entries the lower half by count is let go), merges the tasks' summaries in two
levels, and gives them their counts; that table, `table_size` entries at most, is
broadcast. The second pass looks every pre-token up there, then in the worker's
cache, and encodes only what is in neither, one batch a block.

Texts with characters whose class (letter, number, space) may depend on the
Unicode version or the regular-expression library are split by the library's own
pre-tokenizer and looked up like the others. Only texts that hold an added token's
string are counted whole by the library.

Edge cases: a null or empty text has 0 bytes and 0 tokens.
"""

from __future__ import annotations

import os
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letters and numbers below U+0220, as the tokenizer's pattern knows them, and that pattern:
#: '(?:s|t|re|ve|m|ll|d), then letters, numbers or other signs with a blank before them, then white space.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u021f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_UNSAFE = re.compile("[\x1c-\x1f\x85\u0220-\u1fff\u2070-\U0010ffff]")
_BLOCK_CHARS = 500_000
_CACHE_ENTRIES = 400_000
_caches: dict[str, dict[str, int]] = {}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def _lengths(path: str, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Runs of places in texts with about _BLOCK_CHARS characters."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= _BLOCK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _safe(text: str, added: tuple[str, ...]) -> bool:
    return not _UNSAFE.search(text) and not any(a in text for a in added)


def _pretokens(path: str, text: str) -> list[str] | None:
    """The pre-tokens of text; None if it must be counted whole."""
    added = _added(path)
    if _safe(text, added):
        return _SPLIT.findall(text)
    if any(a in text for a in added):
        return None
    parts = [text[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return parts if "".join(parts) == text else None


def _frequent(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for block in _blocks(texts):
                for i in block:
                    if texts[i]:
                        seen.update(_SPLIT.findall(texts[i]) if path is None else _pretokens(path, texts[i]) or [])
                if len(seen) > 8 * capacity:
                    seen = Counter(dict(seen.most_common(4 * capacity)))
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "top": pa.array([pickle.dumps(seen.most_common(capacity))], pa.binary())})

    return run


def _merged(blobs, capacity: int) -> list[tuple[str, int]]:
    total: Counter[str] = Counter()
    for b in blobs:
        for token, n in pickle.loads(b):
            total[token] += n
        if len(total) > 8 * capacity:
            total = Counter(dict(total.most_common(4 * capacity)))
    return total.most_common(capacity)


def frequent_pretokens(docs: DataFrame, size: int, fan_in: int = 16, path: str | None = None) -> list[str]:
    """About the `size` most frequent pre-tokens of all texts, from bounded summaries of the tasks. path: the tokenizer, for texts that only it can split."""
    tops = docs.mapInArrow(_frequent(size, path), "part int, top binary")
    parts = docs.rdd.getNumPartitions()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf["part"].min())], "top": [pickle.dumps(_merged(pdf["top"], size))]})

    while parts > fan_in:
        tops = tops.withColumn("part", (F.col("part") / fan_in).cast("int")).groupBy("part").applyInPandas(merge, "part int, top binary")
        parts = -(-parts // fan_in)
    blobs = (r["top"] for r in tops.select("top").collect())  # fan_in summaries of bounded size at most
    return [t for t, _ in _merged(blobs, size)]


def _count(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = shared.value
        cache = _caches.setdefault(path, {})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = np.zeros(len(texts), np.int64)
            n_bytes = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            for block in _blocks(texts):
                parts = [(i, _pretokens(path, texts[i])) for i in block if texts[i]]
                whole = [i for i, s in parts if s is None]
                counts[whole] = _lengths(path, [texts[i] for i in whole]) if whole else 0
                split = [(i, s) for i, s in parts if s is not None]
                distinct = set().union(*(s for _, s in split))
                missing = [t for t in distinct if t not in known and t not in cache]
                own = dict(zip(missing, _lengths(path, missing), strict=True))
                lengths = {t: known.get(t) or own.get(t) or cache[t] for t in distinct}
                for i, s in split:
                    counts[i] = sum(map(lengths.__getitem__, s))
                if len(cache) + len(own) > _CACHE_ENTRIES:
                    cache.clear()
                cache.update(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", table_size: int = 30_000) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row. path: a byte-level BPE in the tokenizers library's JSON."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    frequent = frequent_pretokens(source.select("text"), table_size, path=path)
    table = spark.sparkContext.broadcast(dict(zip(frequent, _lengths(path, frequent), strict=True)) if frequent else {})
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_count(path, table), f"doc_id {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
