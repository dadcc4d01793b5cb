"""Motif scan: every motif on both strands of every sequence.

Weight matrices go to the tasks once; each batch of sequences is scanned as one
array of base codes, motif by motif. Windows over a two-allele code are scored
for every genotype, others need plain bases throughout. Long sequences are cut
into overlapping chunks first, so a task holds a chunk, not a chromosome.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.dna import ALLELES, BASES, CODE_OF, TWO_ALLELES
from .background import next_base_tables

MOST_AMBIGUOUS = 7  # codes in a window; windows with more have no hit
_CODES = list(TWO_ALLELES)


def chunked(sequences: DataFrame, size: int, overlap: int) -> DataFrame:
    """seq_id, offset, seq, core: pieces of size letters with `overlap` more; a hit belongs to the piece whose core its first letter is in."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    cut = sequences.select("seq_id", "seq", F.explode(starts).alias("offset"))
    piece = F.col("seq").substr(F.greatest(F.col("offset") + 1, F.lit(1)), F.lit(size + overlap))
    return cut.select("seq_id", "offset", piece.alias("seq"), F.lit(size).alias("core"))


def _strands(weights: Mapping[str, np.ndarray]) -> list[tuple[str, str, np.ndarray]]:
    out = []
    for name, w in weights.items():
        out += [(name, "+", w), (name, "-", w[::-1, ::-1])]
    return out


def _ambiguous_hits(codes: np.ndarray, at: int, w: np.ndarray, cutoff: float, off: np.ndarray | None, strict: bool):
    """Score, lowest passing score and allele records of the window at `at`, or None. off: background of each genotype, if any."""
    window = codes[at : at + w.shape[1]]
    places = np.flatnonzero(window >= 5)
    if len(places) > MOST_AMBIGUOUS or (window == 4).any():
        return None
    columns = np.arange(len(window))
    passing: list[tuple[float, tuple[int, ...]]] = []
    for k, genotype in enumerate(product((0, 1), repeat=len(places))):
        own = window.copy()
        own[places] = ALLELES[window[places] - 5, list(genotype)]
        score = float(w[own, columns].sum()) - (0.0 if off is None else off[k])
        if score > cutoff or score == cutoff and not strict:
            passing.append((score, genotype))
    if not passing:
        return None
    snps = []
    for i, place in enumerate(places):
        pair = ALLELES[window[place] - 5]
        seen = {g[i] for _, g in passing}
        diff = float(w[pair[0], place] - w[pair[1], place])
        if len(seen) == 1 or abs(diff) > 0:
            allele = BASES[pair[seen.pop()]] if len(seen) == 1 else "N"
            snps.append({"ambig": _CODES[window[place] - 5], "allele": allele, "offset": int(place) + 1, "score_diff": diff})
    return max(s for s, _ in passing), min(s for s, _ in passing), snps


def _background_prefix(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """log2 P of each base after those before it in its clean run; 0 at other letters."""
    plain = codes < 4
    n = len(codes)
    index = np.arange(n)
    last_bad = np.maximum.accumulate(np.where(plain, -1, index))
    known = np.minimum(index - last_bad, len(tables))
    out = np.zeros(n)
    number = np.zeros(n, np.int64)
    for k in range(1, len(tables) + 1):  # numbers of the last k bases
        shifted = np.zeros(n, np.int64)
        shifted[k - 1 :] = codes[: max(n - k + 1, 0)]
        number = number + np.where(known >= k, shifted, 0) * 4 ** (k - 1)
        at = known == k
        out[at] = tables[k - 1][number[at]]
    return out


def _genotype_background(codes: np.ndarray, at: int, width: int, tables: list[np.ndarray]) -> np.ndarray:
    """Background of each genotype of a window, given the clean bases before it."""
    begin = at
    while begin > 0 and at - begin < len(tables) - 1 and codes[begin - 1] < 4:
        begin -= 1
    piece = codes[begin : at + width]
    places = np.flatnonzero(piece >= 5)
    out = []
    for genotype in product((0, 1), repeat=len(places)):
        own = piece.copy()
        own[places] = ALLELES[piece[places] - 5, list(genotype)]
        out.append(_background_prefix(own, tables)[at - begin :].sum())
    return np.array(out)


def scan_codes(codes: np.ndarray, weights: Mapping[str, np.ndarray], cutoffs: Mapping[str, float], background: np.ndarray | None = None) -> Iterator[tuple]:
    """(motif, strand, first place, score, lowest score, allele records) of all hits in one sequence of codes.

    Without background the weights are log odds and a hit scores the cutoff or more; with gram counts they are logs
    of frequencies, the background of the window is taken off, and a hit scores more than the cutoff.
    """
    tables = None if background is None else next_base_tables(background)
    n = len(codes)
    padded = np.minimum(codes, 4)
    unclean = np.r_[0, np.cumsum(codes >= 4)]
    ambiguous = np.flatnonzero(codes >= 5)
    below = None if tables is None else np.r_[0.0, np.cumsum(_background_prefix(codes, tables))]
    for motif, strand, w in _strands(weights):
        width = w.shape[1]
        if n < width:
            continue
        cutoff = cutoffs[motif]
        rows = np.vstack([w, np.zeros(width)])
        score = np.zeros(n - width + 1)
        for j in range(width):
            score += rows[padded[j : n - width + 1 + j], j]
        if below is not None:
            score -= below[width:] - below[:-width]
        good = unclean[width:] == unclean[:-width]
        good &= score > cutoff if tables is not None else score >= cutoff
        for at in np.flatnonzero(good):
            yield motif, strand, int(at), float(score[at]), float(score[at]), []
        windows = np.unique((ambiguous[:, None] - np.arange(width)[None, :]).ravel()) if len(ambiguous) else ambiguous
        for at in windows[(windows >= 0) & (windows <= n - width)]:
            off = None if tables is None or (codes[at : at + width] == 4).any() or (codes[at : at + width] >= 5).sum() > MOST_AMBIGUOUS else _genotype_background(codes, int(at), width, tables)
            if (hit := _ambiguous_hits(codes, int(at), w, cutoff, off, tables is not None)) is not None:
                yield motif, strand, int(at), *hit


def _plain_hits(raw: np.ndarray, offsets: np.ndarray, w: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the hits in many sequences of plain bases and letters that break windows, side by side."""
    width = w.shape[1]
    if len(raw) < width:
        return np.zeros(0, np.int64), np.zeros(0)
    n = len(raw) - width + 1
    rows = np.vstack([w, np.full(width, -np.inf)])
    score = np.zeros(n)
    for j in range(width):
        score += rows[raw[j : j + n], j]
    at = np.flatnonzero(score >= cutoff)
    row = np.searchsorted(offsets, at, "right")
    at = at[at + width <= offsets[np.minimum(row, len(offsets) - 1)]]
    return at, score[at]


_SITES = pa.schema([("seq", pa.string()), ("motif", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("strand", pa.string()), ("alt_score", pa.float64()), ("snps", pa.list_(pa.struct([("ambig", pa.string()), ("allele", pa.string()), ("offset", pa.int32()), ("score_diff", pa.float64())])))])


def scan(sequences: DataFrame, weights: Mapping[str, np.ndarray], cutoffs: Mapping[str, float], background: np.ndarray | None = None) -> DataFrame:
    """Sites of all motifs. sequences: seq_id, seq, and offset and core if they are chunks; null sequences have none."""
    has_chunks = "offset" in sequences.columns
    columns = ["seq_id", "seq", *(["offset", "core"] if has_chunks else [])]
    source = sequences.select(F.col("seq_id").cast("string").alias("seq_id"), *columns[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_id")
            texts = [np.frombuffer((t or "").encode("latin-1", "replace"), np.uint8) for t in batch.column("seq").to_pylist()]
            offset = np.asarray(batch.column("offset")) if has_chunks else np.zeros(len(texts), np.int64)
            core = np.asarray(batch.column("core")) if has_chunks else np.full(len(texts), 1 << 60)
            codes = [CODE_OF[t] for t in texts]
            plain = np.array([background is None and not (c >= 5).any() for c in codes], bool)
            found: list[tuple[np.ndarray, str, str, np.ndarray, np.ndarray, int]] = []
            rows = np.flatnonzero(plain)
            if len(rows):
                flat = np.concatenate([codes[i] for i in rows]) if len(rows) else np.zeros(0, np.int8)
                ends = np.cumsum([len(codes[i]) for i in rows])
                for motif, strand, w in _strands(weights):
                    at, score = _plain_hits(flat, ends, w, cutoffs[motif])
                    nth = np.searchsorted(ends, at, "right")
                    place = at - np.r_[0, ends][nth]
                    own = rows[nth]
                    keep = place < core[own]
                    found.append((own[keep], motif, strand, place[keep], score[keep], w.shape[1]))
            for own, motif, strand, place, score, width in found:
                if len(own):
                    begin = pa.array(place + offset[own] + 1, pa.int32())
                    end = pa.array(place + offset[own] + width, pa.int32())
                    empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(own) + 1), pa.int32()), pa.array([], _SITES.field("snps").type.value_type))
                    const = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(own), np.int64))) for x in (motif, strand)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), const[0], begin, end, pa.array(score), const[1], pa.array(score), empty], schema=_SITES)
            out = []
            for i in np.flatnonzero(~plain):
                name = ids[int(i)].as_py()
                for motif, strand, at, score, low, snps in scan_codes(codes[i], weights, cutoffs, background):
                    if at < core[i]:
                        begin = at + int(offset[i]) + 1
                        out.append({"seq": name, "motif": motif, "begin": begin, "end": begin + weights[motif].shape[1] - 1, "score": score, "strand": strand, "alt_score": low, "snps": snps})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SITES)

    return source.mapInArrow(run, T.StructType.fromDDL(schemas.SITES) if hasattr(T.StructType, "fromDDL") else schemas.SITES)
