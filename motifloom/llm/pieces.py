"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

A text is cut into units that no merge can cross: a run of blanks with the
characters after it, and each line break by itself. In every unit the candidate
merge of best rank, leftmost first, is done until none is left. A candidate is
known by the places where its two parts begin and end; it is skipped for good if
a hash keyed by seed, document, unit and those places falls below the dropout
rate. So the segmentation is a function of (seed, document, text) alone, differs
from document to document, and at rate 0 equals the library's. Units of up to
64 characters are merged side by side as matrices; longer ones through a heap.

Decoding concatenates the pieces' bytes and takes away the blank that encoding
puts first, so it gives back every text, whatever was skipped. The blank's own
stand-in character, if it occurs in a text, is encoded by bytes.

Edge cases: null texts have null ids; empty texts have none.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

U64 = np.uint64
_BLANK = "▁"
_MATRIX = 64  # characters
_WIDTHS = (4, 8, 16, 32, _MATRIX)
_NEVER = np.int64(1 << 62)
_ID_BITS = 24  # a merge is its rank, then the merged piece's id; equal scores have one rank
_M64 = (1 << 64) - 1


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays. A symbol is a piece's id, or `other` if it is in none."""

    other: int
    byte_0: int
    points: np.ndarray  # sorted code points that are pieces
    point_ids: np.ndarray
    slots: int  # of the pair table, a power of two; each pair lies in one of two
    pair_key: np.ndarray
    pair_merge: np.ndarray
    text: np.ndarray  # bytes of all pieces, with blanks
    text_at: np.ndarray


def _slots(key: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    a = key * U64(0x9E3779B97F4A7C15)
    b = (key ^ (key >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    bits = U64(65 - slots.bit_length())
    return a >> bits, b >> bits


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary of a sentencepiece BPE model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = {names[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    byte_0 = next(i for i in range(n) if model.is_byte(i))
    scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
    rank = {score: r for r, score in enumerate(scores)}
    pairs = {}
    for name, i in plain.items():
        for k in range(1, len(name)):
            if (a := plain.get(name[:k])) is not None and (b := plain.get(name[k:])) is not None:
                pairs[a << 32 | b] = rank[model.get_score(i)] << _ID_BITS | i
    singles = sorted((ord(name), i) for name, i in plain.items() if len(name) == 1 and name != _BLANK)
    singles = sorted([*singles, (32, plain[_BLANK])])
    slots = 1 << max(8, (4 * len(pairs)).bit_length())
    keys = np.array(list(pairs), U64)
    first, second = _slots(keys, slots)
    table_key, table_id = np.full(slots, _M64, U64), np.full(slots, _NEVER, np.int64)
    for key, a, b in zip(keys.tolist(), first.tolist(), second.tolist(), strict=True):
        at, item = a, (key, a, b)
        for _ in range(500):  # move along whoever lies there
            old = int(table_key[at])
            table_key[at], table_id[at] = item[0], pairs[item[0]]
            if old == _M64:
                break
            x, y = (int(v[0]) for v in _slots(np.array([old], U64), slots))
            item, at = (old, x, y), y if at == x else x
        else:
            raise ValueError("the pair table is too full")
    texts = [bytes([i - byte_0]) if model.is_byte(i) else names[i].replace(_BLANK, " ").encode() if names[i] in plain and plain[names[i]] == i else b"" for i in range(n)]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    return Pieces(n, byte_0, np.array([p for p, _ in singles], np.uint32), np.array([i for _, i in singles], np.int32), slots, table_key, table_id, np.frombuffer(b"".join(texts), np.uint8), at)


def _merged(p: Pieces, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each pair's merge, or _NEVER."""
    key = left.astype(U64) << U64(32) | right.astype(U64)
    a, b = _slots(key, p.slots)
    return np.where(p.pair_key[a] == key, p.pair_merge[a], np.where(p.pair_key[b] == key, p.pair_merge[b], _NEVER))


def _kept(salt: np.ndarray, begin: np.ndarray, mid: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """False for the candidates that are skipped."""
    place = begin.astype(U64) << U64(42) | mid.astype(U64) << U64(21) | end.astype(U64)
    return W.mix(salt ^ place * U64(0xD6E8FEB86659FD93)) >= U64(least)


def _ranks(p: Pieces, ids: np.ndarray, begins: np.ndarray, salt: np.ndarray, least: int) -> np.ndarray:
    """Of adjacent symbols ids[:, i], ids[:, i + 1]; begins has one column more than ids."""
    out = _merged(p, ids[:, :-1], ids[:, 1:])
    if least:
        out[~_kept(salt[:, None], begins[:, :-2], begins[:, 1:-1], begins[:, 2:], least)] = _NEVER
    return out


def _merge_matrix(p: Pieces, ids: np.ndarray, sizes: np.ndarray, salt: np.ndarray, least: int):
    """Yields (rows, ids, begins, counts) of the units that are done; ids has one row a unit, filled up with `other`."""
    n, width = ids.shape
    rows = np.arange(n)
    begins = np.minimum(np.arange(width + 1, dtype=np.int32), sizes[:, None].astype(np.int32))
    counts = sizes.copy()
    ranks = _ranks(p, ids, begins, salt, least) if width > 1 else np.zeros((n, 0), np.int64)
    while len(rows):
        if ids.shape[1] == 1:
            yield rows, ids, begins, counts
            return
        best = (ranks >> _ID_BITS).argmin(axis=1)
        value = ranks[np.arange(len(rows)), best]
        over = value == _NEVER
        if over.any():
            yield rows[over], ids[over], begins[over], counts[over]
            go = ~over
            rows, ids, begins, counts, ranks, salt, best, value = (x[go] for x in (rows, ids, begins, counts, ranks, salt, best, value))
            if not len(rows):
                return
        r = np.arange(len(rows))
        ids[r, best] = value & ((1 << _ID_BITS) - 1)
        gone = best[:, None] + 1
        columns = np.arange(ids.shape[1] - 1)[None, :]
        source = columns + (columns >= gone)
        ids = np.take_along_axis(ids, source, 1)
        begins = np.take_along_axis(begins, np.concatenate([source, np.full((len(rows), 1), begins.shape[1] - 1)], axis=1), 1)
        rank_columns = columns[:, :-1]
        ranks = np.take_along_axis(ranks, rank_columns + (rank_columns >= best[:, None]), 1)
        counts = counts - 1
        for side in (-1, 0):
            at = best + side
            ok = (at >= 0) & (at < ranks.shape[1])
            w, c = r[ok], at[ok]
            fresh = _merged(p, ids[w, c], ids[w, c + 1])
            if least:
                fresh[~_kept(salt[w], begins[w, c], begins[w, c + 1], begins[w, c + 2], least)] = _NEVER
            ranks[w, c] = fresh


def _merge_long(p: Pieces, ids: np.ndarray, salt: int, least: int) -> tuple[list[int], list[int]]:
    """The same for one unit of any length, through an agenda: its symbols and where they begin."""
    n = len(ids)
    sym, begin = ids.tolist(), list(range(n))
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    version = [0] * n
    salt_, least_ = np.array([salt], U64), least

    def candidates(left: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(rank, place, id, right, versions) of the pairs that begin at symbols left."""
        right = np.array([after[i] for i in left])
        merged = _merged(p, np.array([sym[i] for i in left]), np.array([sym[i] for i in right]))
        if least_:
            merged[~_kept(salt_, *(np.array(x) for x in ([begin[i] for i in left], [begin[i] for i in right], [end[i] for i in right])), least_)] = _NEVER
        return [(int(m) >> _ID_BITS, int(i), int(m) & ((1 << _ID_BITS) - 1), int(j), version[i], version[j]) for m, i, j in zip(merged, left, right, strict=True) if m != _NEVER]

    agenda = candidates(np.arange(n - 1)) if n > 1 else []
    heapq.heapify(agenda)
    while agenda:
        _, i, merged, j, vi, vj = heapq.heappop(agenda)
        if version[i] != vi or version[j] != vj or after[i] != j:
            continue
        sym[i], end[i], after[i] = merged, end[j], after[j]
        version[i] += 1
        version[j] += 1
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -2
        around = [k for k in (before[i], i) if k >= 0 and after[k] >= 0]
        for c in candidates(np.array(around)) if around else ():
            heapq.heappush(agenda, c)
    left = [i for i in range(n) if after[i] != -2]
    return [sym[i] for i in left], [begin[i] for i in left]


def _flat(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size-1 for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _encode_units(p: Pieces, points: np.ndarray, at: np.ndarray, salt: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after the other, and each unit's count. Unit u has the code points points[at[u]:at[u + 1]]."""
    place = np.minimum(np.searchsorted(p.points, points), len(p.points) - 1)
    symbols = np.where(p.points[place] == points, p.point_ids[place], np.int32(p.other))
    sizes = np.diff(at)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, symbol, first point; one entry a symbol
    least_size = 0
    for width in _WIDTHS:
        units = np.flatnonzero((sizes > least_size) & (sizes <= width))
        least_size = width
        for part in np.array_split(units, max(1, -(-len(units) * width // 1_500_000))):
            if not len(part):
                continue
            ids = np.full((len(part), width), p.other, np.int32)
            inside = np.arange(width) < sizes[part][:, None]
            ids[inside] = symbols[np.repeat(at[part], sizes[part]) + _flat(sizes[part])]
            for rows, got, begins, counts in _merge_matrix(p, ids, sizes[part], salt[part], least):
                full = np.arange(got.shape[1]) < counts[:, None]
                unit = np.repeat(part[rows], counts)
                done.append((unit, got[full], at[unit] + begins[:, :-1][full]))
    for u in np.flatnonzero(sizes > _MATRIX):
        got, begins = _merge_long(p, symbols[at[u] : at[u + 1]], int(salt[u]), least)
        done.append((np.full(len(got), u), np.array(got, np.int32), at[u] + np.array(begins)))
    if not done:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    unit, symbol, point = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.argsort(point, kind="stable")  # units follow each other in points
    unit, symbol, point = unit[order], symbol[order], points[point[order]]
    unknown = symbol == p.other
    if unknown.any():
        widths = np.where(unknown, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        raw = np.frombuffer(point[unknown].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        out = np.repeat(symbol, widths)
        out[np.repeat(unknown, widths)] = raw.astype(np.int32) + p.byte_0
        symbol, unit = out, np.repeat(unit, widths)
    return symbol, np.bincount(unit, minlength=len(sizes))


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """raw with a blank before each text that is not empty; the texts' offsets; where units begin; their text."""
    sizes = np.diff(offsets)
    more = np.r_[0, np.cumsum(sizes > 0)]
    own = offsets + more
    out = np.full(own[-1], 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(more[1:], sizes)] = raw
    blank, line = out == 32, out == 10
    begins = line.copy()
    begins[1:] |= line[:-1] | blank[1:] & ~blank[:-1]
    begins[own[:-1][sizes > 0]] = True
    begin = np.flatnonzero(begins)
    return out, own, begin, np.searchsorted(own, begin, "right") - 1


def encode_block(p: Pieces, raw: np.ndarray, offsets: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the texts one after the other, each text's count, and whether decoding gives it back. key: a hash of each text's document and the seed."""
    out, own, begin, text = _units(raw, offsets)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(begin):
        return np.zeros(0, np.int32), counts, np.ones(len(counts), bool)
    end = np.r_[begin[1:], len(out)]
    hashes = W.span_hashes(out, begin, end)
    least = int(rate * (1 << 64)) if rate > 0 else 0
    unit = W.pair(hashes, key[text]) if least else hashes
    distinct, one, back = np.unique(unit, return_index=True, return_inverse=True)
    s, sizes = begin[one], (end - begin)[one]
    gathered = out[np.repeat(s, sizes) + _flat(sizes)]
    points = np.frombuffer(gathered.tobytes().decode().encode("utf-32-le"), np.uint32)
    firsts = np.r_[0, np.cumsum((gathered & 0xC0) != 0x80)]
    at = firsts[np.r_[0, np.cumsum(sizes)]]
    ids, lengths = _encode_units(p, points, at, distinct, min(least, _M64))
    starts = np.cumsum(lengths) - lengths
    each = lengths[back]
    whole = ids[np.repeat(starts[back], each) + _flat(each)]
    counts = np.bincount(text, weights=each, minlength=len(counts)).astype(np.int64)
    decoded, sizes = decode_block(p, whole, counts)
    return whole, counts, _same(out, own, decoded, sizes)


def _same(out: np.ndarray, own: np.ndarray, decoded: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each text of out (offsets own) is that of decoded: the size, and then every byte."""
    fits = sizes == np.diff(own)
    differ = decoded[np.repeat(fits, sizes)] != out[np.repeat(fits, np.diff(own))]
    wrong, at = np.r_[0, np.cumsum(differ)], np.r_[0, np.cumsum(np.where(fits, sizes, 0))]
    return fits & (wrong[at[1:]] == wrong[at[:-1]])


def decode_block(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with its first blank, and their sizes."""
    widths = np.diff(p.text_at)[ids]
    total = np.r_[0, np.cumsum(widths)]
    return p.text[np.repeat(p.text_at[ids], widths) + _flat(widths)], np.diff(total[np.r_[0, np.cumsum(counts)]])


def _keys(ids: pa.Array, seed: int) -> np.ndarray:
    h = [0 if x is None else x & _M64 if isinstance(x, int) else zlib.crc32(str(x).encode()) for x in ids.to_pylist()]
    return W.mix(np.array(h, U64) + U64(seed & _M64) * U64(0x9E3779B97F4A7C15))


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", rate: float = 0.1, seed: int = 0, name: str = "ids") -> DataFrame:
    """doc_id, ids (named by name), n_pieces and round_trip (decoding gave the text back) of each row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            keys = _keys(batch.column("doc_id"), seed)
            for b in W.blocks(batch.column("text"), block_bytes=1_000_000):
                ids, counts, same = encode_block(p, b.raw, b.offsets, keys[b.first : b.first + b.rows], rate)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~b.valid))
                columns = [batch.column("doc_id").slice(b.first, b.rows), lists, pa.array(counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", name: str = "text") -> DataFrame:
    """encoded with one more column: the text of ids (null for null)."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            texts = []
            for row in batch.column(ids):
                own = np.asarray(row.values, np.int64) if row.is_valid else None
                texts.append(None if own is None else decode_block(p, own, np.array([len(own)]))[0].tobytes()[1:].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")), rate=0.1, seed=17)
