"""Scans of all sequences with each kind of cutoff and background."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import background as B
from ..operators import motifs as M
from ..operators import scan as S
from ..operators import threshold as T
from ..operators.sites import match_counts
from ..sinks.gff import site_lines
from . import inputs as I

ABSOLUTE, RELATIVE, P_VALUE, MARKOV = 5.03, 0.1, 0.002, 4.03
_CHUNK = 1_000_000


def weights() -> dict[str, np.ndarray]:
    """Log odds of the queries' motifs against the uniform background."""
    out = {}
    for name, rows in I.MATRICES.items():
        counts = np.array(rows, float)
        out[name] = np.log2((counts + 0.25) / (counts.sum(axis=0) + 1) / 0.25)
    return out


def _chunks(spark, sf_dir):
    return S.chunked(I.sequences(spark, sf_dir), _CHUNK, max(len(m[0]) for m in I.MATRICES.values()) - 1)


def _scanned(spark, sf_dir, kind: str, value: float):
    w = M.matrices(M.derived(I.motifs(spark)), "weight")
    return S.scan(_chunks(spark, sf_dir), w, T.cutoffs(w, kind, value))


def _plain(sites):
    return sites.select("seq", "motif", "begin", "end", F.round("score", 6).alias("score"), "strand")


def scan_absolute(spark, sf_dir):
    return _plain(_scanned(spark, sf_dir, "absolute", ABSOLUTE))


def scan_relative(spark, sf_dir):
    return _plain(_scanned(spark, sf_dir, "relative", RELATIVE))


def scan_pvalue(spark, sf_dir):
    return _plain(_scanned(spark, sf_dir, "pvalue", P_VALUE))


def scan_markov(spark, sf_dir):
    """Against a background of order 2, counted in the sequences themselves."""
    counts = B.gram_vector(B.gram_counts(I.sequences(spark, sf_dir), 2), 2)
    w = M.matrices(M.derived(I.motifs(spark)), "positive_weight")
    return _plain(S.scan(I.sequences(spark, sf_dir), w, T.cutoffs(w, "absolute", MARKOV), counts))


def scan_counts(spark, sf_dir):
    return match_counts(_scanned(spark, sf_dir, "absolute", ABSOLUTE))


def scan_gff(spark, sf_dir):
    return site_lines(_scanned(spark, sf_dir, "absolute", ABSOLUTE))


def words_above(spark, sf_dir):
    """All words that score half a motif's best or more."""
    found = [(m, word, score) for m, w in weights().items() for word, score in T.sequences_above(w, float(w.max(axis=0).sum()) / 2)]
    return spark.createDataFrame(found, "motif string, word string, score double").select("motif", "word", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (scan_absolute, scan_relative, scan_pvalue, scan_markov, scan_counts, scan_gff, words_above)}


#: Cutoffs (motif, cut), worked out from the weights w: the best score less a part, and the distribution over all words.
_RELATIVE = f"SELECT motif, log2({RELATIVE}) + sum(best) AS cut FROM (SELECT motif, pos, max(weight) AS best FROM w GROUP BY motif, pos) GROUP BY motif"
_P_VALUE = f"""WITH RECURSIVE z AS (SELECT motif, 1000.0 / (max(weight) - min(weight)) AS scale, max(pos) + 1 AS width FROM w GROUP BY motif),
      i AS (SELECT w.motif, pos, base, CAST(sign(weight) * floor(abs(weight * scale) + 0.5) AS BIGINT) AS step FROM w JOIN z ON z.motif = w.motif),
      r AS (SELECT motif, 0 AS n, CAST(0 AS BIGINT) AS score FROM z UNION ALL SELECT r.motif, n + 1, score + step FROM r JOIN i ON i.motif = r.motif AND i.pos = n),
      d AS (SELECT r.motif, score, count(*) / pow(4, any_value(width)) AS share, any_value(scale) AS scale FROM r JOIN z ON z.motif = r.motif AND n = width GROUP BY r.motif, score),
      c AS (SELECT *, sum(share) OVER o AS total, lag(score) OVER o AS above, max(score) OVER (PARTITION BY motif) AS top FROM d WINDOW o AS (PARTITION BY motif ORDER BY score DESC)),
      m AS (SELECT motif, max(score) AS score FROM c WHERE total > {P_VALUE} GROUP BY motif)
    SELECT c.motif, trunc((c.score + 1 + coalesce(above, 2 * (top + 1))) / 2.0) / scale AS cut FROM c JOIN m ON m.motif = c.motif AND m.score = c.score"""


def _scan_sql(cutoffs: str, column: str = "weight", strict: bool = False) -> str:
    cut = "(SELECT cut FROM k WHERE k.motif = h.motif)"
    return f"""WITH s AS ({I.SEQUENCES_SQL}), w AS ({I.WEIGHTS_SQL}), k AS ({cutoffs}), x AS (SELECT motif, max(pos) + 1 AS width FROM w GROUP BY motif),
    b AS (SELECT w.motif, '+' AS strand, pos, base, {column} AS weight FROM w UNION ALL SELECT w.motif, '-', x.width - 1 - pos, translate(base, 'ACGT', 'TGCA'), {column} FROM w JOIN x ON x.motif = w.motif),
    p AS (SELECT seq_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS base FROM s WHERE seq <> ''),
    l AS (SELECT seq_id, length(seq) AS n FROM s),
    h AS (SELECT p.seq_id, b.motif, b.strand, p.i - b.pos AS begin_, sum(b.weight) AS score FROM p JOIN b ON b.base = p.base GROUP BY ALL),
    f AS (SELECT h.seq_id AS seq, h.motif, CAST(begin_ AS INTEGER) AS begin, CAST(begin_ + x.width - 1 AS INTEGER) AS "end", h.score, h.strand FROM h JOIN x ON x.motif = h.motif JOIN l ON l.seq_id = h.seq_id
      WHERE begin_ >= 1 AND begin_ + x.width - 1 <= l.n AND h.score {'>' if strict else '>='} {cut})"""


_MARKOV_SQL = f"""WITH s AS ({I.SEQUENCES_SQL}), w AS ({I.WEIGHTS_SQL}), x AS (SELECT motif, max(pos) + 1 AS width FROM w GROUP BY motif),
    b AS (SELECT w.motif, '+' AS strand, pos, base, log2(freq) AS weight FROM w UNION ALL SELECT w.motif, '-', x.width - 1 - pos, translate(base, 'ACGT', 'TGCA'), log2(freq) FROM w JOIN x ON x.motif = w.motif),
    p AS (SELECT seq_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS base FROM s WHERE seq <> ''),
    l AS (SELECT seq_id, length(seq) AS n FROM s),
    t AS (SELECT *, lag(base) OVER o AS b1, lag(base, 2) OVER o AS b2 FROM p WINDOW o AS (PARTITION BY seq_id ORDER BY i)),
    g AS (SELECT b2, b1, base, count(*) AS n FROM t WHERE b2 IS NOT NULL GROUP BY ALL),
    c3 AS (SELECT b2, b1, sum(n) AS n FROM g GROUP BY ALL), g2 AS (SELECT b1, base, sum(n) AS n FROM g GROUP BY ALL), c2 AS (SELECT b1, sum(n) AS n FROM g GROUP BY ALL), g1 AS (SELECT base, sum(n) AS n FROM g GROUP BY ALL),
    q AS (SELECT t.seq_id, t.i, t.base,
      CASE WHEN t.b2 IS NOT NULL THEN log2(coalesce(g.n, 0) + 0.25) - log2(coalesce(c3.n, 0) + 1) WHEN t.b1 IS NOT NULL THEN log2(coalesce(g2.n, 0) + 0.25) - log2(coalesce(c2.n, 0) + 1) ELSE log2(coalesce(g1.n, 0) + 0.25) - log2((SELECT sum(n) FROM g1) + 1) END AS lp
      FROM t LEFT JOIN g ON g.b2 = t.b2 AND g.b1 = t.b1 AND g.base = t.base LEFT JOIN c3 ON c3.b2 = t.b2 AND c3.b1 = t.b1 LEFT JOIN g2 ON g2.b1 = t.b1 AND g2.base = t.base LEFT JOIN c2 ON c2.b1 = t.b1 LEFT JOIN g1 ON g1.base = t.base),
    h AS (SELECT q.seq_id, b.motif, b.strand, q.i - b.pos AS begin_, sum(b.weight - q.lp) AS score FROM q JOIN b ON b.base = q.base GROUP BY ALL)
    SELECT h.seq_id AS seq, h.motif, CAST(begin_ AS INTEGER) AS begin, CAST(begin_ + x.width - 1 AS INTEGER) AS "end", round(h.score, 6) AS score, h.strand FROM h JOIN x ON x.motif = h.motif JOIN l ON l.seq_id = h.seq_id
    WHERE begin_ >= 1 AND begin_ + x.width - 1 <= l.n AND h.score > {MARKOV}"""

_PLAIN = ' SELECT seq, motif, begin, "end", round(score, 6) AS score, strand FROM f'
_SCAN = _scan_sql(f"SELECT DISTINCT motif, {ABSOLUTE} AS cut FROM w")

ORACLE_SQL = {
    "scan_absolute": _SCAN + _PLAIN,
    "scan_relative": _scan_sql(_RELATIVE) + _PLAIN,
    "scan_pvalue": _scan_sql(_P_VALUE) + _PLAIN,
    "scan_markov": _MARKOV_SQL,
    "words_above": f"""WITH RECURSIVE w AS ({I.WEIGHTS_SQL}), b AS (SELECT motif, max(pos) + 1 AS width FROM w GROUP BY motif), t AS (SELECT motif, sum(best) / 2 AS least FROM (SELECT motif, pos, max(weight) AS best FROM w GROUP BY motif, pos) GROUP BY motif),
        r AS (SELECT motif, 0 AS n, '' AS word, CAST(0 AS DOUBLE) AS score FROM b UNION ALL SELECT r.motif, n + 1, word || base, r.score + weight FROM r JOIN w ON w.motif = r.motif AND w.pos = n)
        SELECT r.motif, word, round(score, 6) AS score FROM r JOIN b ON b.motif = r.motif AND n = width JOIN t ON t.motif = r.motif WHERE score >= least""",
    "scan_counts": _SCAN + " SELECT seq, count(*) AS n FROM f GROUP BY ROLLUP (seq)",
    "scan_gff": _SCAN + """ SELECT concat_ws(chr(9), seq, 'scan', motif, CAST(begin AS VARCHAR), CAST("end" AS VARCHAR), printf('%.6f', score), strand, '.', '') AS value FROM f""",
}
