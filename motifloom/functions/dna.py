"""Nucleotide strings: complements, ambiguity codes, edit distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: The two bases that a code stands for.
TWO_ALLELES = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT"}
#: All codes and the bases they stand for.
CODES = {**TWO_ALLELES, "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}

#: Byte -> 0..3 for bases in either case, 5.. for two-allele codes, 4 for all else.
CODE_OF = np.full(256, 4, np.int8)
for _i, _b in enumerate(BASES):
    CODE_OF[ord(_b)] = CODE_OF[ord(_b.lower())] = _i
for _i, _b in enumerate(TWO_ALLELES):
    CODE_OF[ord(_b)] = CODE_OF[ord(_b.lower())] = 5 + _i
ALLELES = np.array([[BASES.index(x) for x in pair] for pair in TWO_ALLELES.values()])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtRYMKrymk", "TGCAtgcaYRKMyrkm"))


def codes_match(a: str, b: str) -> bool:
    """Equal, or members of one class: a code and its bases, or two bases of one code."""
    return a == b or any({a, b} <= {code, *bases} for code, bases in CODES.items())


def edit_distance(a: str, b: str, count_ends: bool = True) -> int:
    """Levenshtein distance; without count_ends, what the longer string has before and after costs nothing."""
    short, long = sorted((a, b), key=len)
    row = list(range(len(short) + 1))
    best = row[-1]
    for i, x in enumerate(long, 1):
        before, row[0] = row[0], (i if count_ends else 0)
        for j, y in enumerate(short, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        best = min(best, row[-1])
    return row[-1] if count_ends else best


def align_strings(a: str, b: str, count_ends: bool = True, ambiguous: bool = False) -> tuple[int, str, str]:
    """Levenshtein distance and the two strings with gaps; a gap is preferred where costs tie."""
    same = codes_match if ambiguous else (lambda x, y: x == y)
    m, n = len(a), len(b)
    d = np.zeros((m + 1, n + 1), int)
    d[:, 0] = np.arange(m + 1) * (count_ends or m <= n)
    d[0, :] = np.arange(n + 1) * (count_ends or n <= m)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            down = d[i - 1, j] + (1 if count_ends or j < n or m <= n else 0)
            right = d[i, j - 1] + (1 if count_ends or i < m or n <= m else 0)
            d[i, j] = min(d[i - 1, j - 1] + (not same(a[i - 1], b[j - 1])), down, right)
    i, j, top, bottom = m, n, [], []
    while i or j:
        down = i > 0 and d[i, j] == d[i - 1, j] + (1 if (count_ends or 0 < j < n or m <= n) else 0)
        right = j > 0 and d[i, j] == d[i, j - 1] + (1 if (count_ends or 0 < i < m or n <= m) else 0)
        if down or not j:
            i -= 1
            top.append(a[i])
            bottom.append("-")
        elif right or not i:
            j -= 1
            top.append("-")
            bottom.append(b[j])
        else:
            i, j = i - 1, j - 1
            top.append(a[i])
            bottom.append(b[j])
    return int(d[m, n]), "".join(reversed(top)), "".join(reversed(bottom))


_ALIGNED = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@F.pandas_udf(T.IntegerType())
def free_end_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """edit_distance without the ends of the longer string; null for null."""
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else edit_distance(x, y, False) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(_ALIGNED)
def aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """align_strings of two columns."""
    for a, b in batches:
        yield pd.DataFrame([(None, None, None) if x is None or y is None else align_strings(x, y) for x, y in zip(a, b, strict=True)], columns=["distance", "a", "b"])
