"""Motif tables, comparisons and backgrounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as B
from ..operators import compare as C
from ..operators import motifs as M
from . import inputs as I


def _rounded(df, *names: str):
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


def motif_weights(spark, sf_dir):
    return _rounded(M.derived(I.motifs(spark)).select("motif", "pos", "base", "freq", "weight", "info"), "freq", "weight", "info")


def motif_positive_weights(spark, sf_dir):
    return _rounded(M.derived(I.motifs(spark), (0.3, 0.2, 0.2, 0.3), 2.0).select("motif", "pos", "base", "positive_weight", "weight"), "positive_weight", "weight")


def motif_summary(spark, sf_dir):
    return _rounded(M.summary(M.derived(I.motifs(spark))), "info", "max_score")


def motif_reverse_complement(spark, sf_dir):
    return M.reverse_complement(I.motifs(spark))


def motif_scaled(spark, sf_dir):
    return M.column_scaled(I.motifs(spark))


def motif_shares(spark, sf_dir):
    return _rounded(M.column_shares(I.motifs(spark)), "share")


def motif_wide(spark, sf_dir):
    return M.wide(I.motifs(spark))


def motif_export(spark, sf_dir):
    out = None
    for style in ("matcompare", "ahab", "columns", "cisevolver"):
        part = M.exported(I.motifs(spark), style).withColumn("style", F.lit(style))
        out = part if out is None else out.unionByName(part)
    return out


def motif_example_sites(spark, sf_dir):
    return M.example_sites(I.motifs(spark))


def relative_entropy(spark, sf_dir):
    return _rounded(C.relative_entropy(I.motifs(spark)).select("a", "b", "distance"), "distance")


def expected_score(spark, sf_dir):
    return _rounded(C.expected_score(I.motifs(spark)).select("a", "b", "score"), "score")


def base_frequencies(spark, sf_dir):
    return _rounded(B.base_frequencies(I.masked(spark, sf_dir)), "freq")


def clean_runs(spark, sf_dir):
    return B.clean_runs(I.masked(spark, sf_dir), 3)


def gram_counts(spark, sf_dir):
    return B.gram_counts(I.masked(spark, sf_dir), 2)


def context_counts(spark, sf_dir):
    return B.context_counts(B.gram_counts(I.masked(spark, sf_dir), 2))


def gram_probability(spark, sf_dir):
    return _rounded(B.gram_probability(B.gram_counts(I.masked(spark, sf_dir), 2)), "p")


def all_gram_counts(spark, sf_dir):
    return B.all_gram_counts(I.sequences(spark, sf_dir), 3)


QUERIES = {f.__name__: f for f in (motif_weights, motif_positive_weights, motif_summary, motif_reverse_complement, motif_scaled, motif_shares, motif_wide, motif_export, motif_example_sites, relative_entropy, expected_score, base_frequencies, clean_runs, gram_counts, context_counts, gram_probability, all_gram_counts)}

_W = f"WITH w AS ({I.WEIGHTS_SQL})"
_BOTH = """, s AS (
  SELECT motif, '+' AS strand, pos, base, freq FROM w UNION ALL
  SELECT w.motif, '-', x.width - 1 - pos, translate(base, 'ACGT', 'TGCA'), freq FROM w JOIN x ON x.motif = w.motif
)"""
_GRAMS = f"""WITH m AS ({I.MASKED_SQL}), r AS (SELECT unnest(string_split_regex(seq, '[^ACGT]+')) AS run FROM m),
g AS (SELECT substring(run, i, 3) AS gram FROM (SELECT run, unnest(range(1, length(run) - 1)) AS i FROM r WHERE length(run) >= 3)),
n AS (SELECT gram, count(*) AS n FROM g GROUP BY gram)"""

ORACLE_SQL = {
    "motif_export": f"""WITH c AS ({I.MOTIFS_SQL}), p AS (SELECT motif, pos, string_agg(CAST(CAST(count AS BIGINT) AS VARCHAR), chr(9) ORDER BY base) AS line FROM c GROUP BY motif, pos),
        l AS (SELECT motif, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS width FROM p GROUP BY motif),
        f AS (SELECT motif, pos, string_agg(printf('%f', freq), ' ' ORDER BY base) AS line FROM ({I.WEIGHTS_SQL}) GROUP BY motif, pos), e AS (SELECT motif, string_agg(line, chr(10) ORDER BY pos) AS body FROM f GROUP BY motif)
        SELECT motif, 'M.' || motif || chr(10) || body || chr(10) || 'END' AS text, 'matcompare' AS style FROM l UNION ALL SELECT motif, '>' || motif || ' Matrix' || chr(9) || width || chr(10) || body || chr(10) || '<', 'ahab' FROM l
        UNION ALL SELECT motif, body || chr(10), 'columns' FROM l UNION ALL SELECT motif, body || chr(10), 'cisevolver' FROM e""",
    "motif_example_sites": f"""WITH c AS ({I.MOTIFS_SQL}), u AS (SELECT *, CAST(sum(CAST(count AS BIGINT)) OVER (PARTITION BY motif, pos ORDER BY base) AS BIGINT) AS upto FROM c),
        x AS (SELECT motif, pos, base, unnest(generate_series(upto - CAST(count AS BIGINT), upto - 1)) AS site FROM u WHERE count >= 1), n AS (SELECT motif, sum(count) AS n FROM c WHERE pos = 0 GROUP BY motif)
        SELECT x.motif, site, string_agg(base, '' ORDER BY pos) AS seq FROM x JOIN n ON n.motif = x.motif WHERE site < n.n GROUP BY x.motif, site""",
    "motif_weights": f"{_W} SELECT motif, CAST(pos AS INTEGER) AS pos, base, round(freq, 6) + 0.0 AS freq, round(weight, 6) + 0.0 AS weight, round(freq * weight, 6) + 0.0 AS info FROM w",
    "motif_positive_weights": f"""WITH m AS ({I.MOTIFS_SQL}), q AS (SELECT *, CASE WHEN base IN ('A', 'T') THEN 0.3 ELSE 0.2 END AS p FROM m),
        f AS (SELECT *, (count + 2 * p) / (sum(count) OVER (PARTITION BY motif, pos) + 2) AS freq FROM q)
        SELECT motif, CAST(pos AS INTEGER) AS pos, base, round(log2(freq), 6) + 0.0 AS positive_weight, round(log2(freq / p), 6) + 0.0 AS weight FROM f""",
    "motif_summary": f"{_W}, a AS (SELECT motif, pos, sum(freq * weight) AS info, max(weight) AS top FROM w GROUP BY motif, pos) SELECT motif, CAST(count(*) AS INTEGER) AS width, round(sum(info), 6) + 0.0 AS info, round(sum(top), 6) + 0.0 AS max_score FROM a GROUP BY motif",
    "motif_reverse_complement": f"WITH m AS ({I.MOTIFS_SQL}) SELECT motif, CAST(max(pos) OVER (PARTITION BY motif) - pos AS INTEGER) AS pos, translate(base, 'ACGT', 'TGCA') AS base, count FROM m",
    "motif_scaled": f"WITH m AS ({I.MOTIFS_SQL}) SELECT motif, CAST(pos AS INTEGER) AS pos, base, round(sum(count) OVER (PARTITION BY motif) * count / sum(count) OVER (PARTITION BY motif, pos)) AS count FROM m",
    "motif_shares": f"""WITH m AS ({I.MOTIFS_SQL}), h AS (SELECT motif, pos, base, count / sum(count) OVER (PARTITION BY motif, pos) AS share FROM m)
        SELECT motif, CAST(pos AS INTEGER) AS pos, base, round(share, 6) + 0.0 AS share, CAST(row_number() OVER (PARTITION BY motif, pos ORDER BY share, base) - 1 AS INTEGER) AS place FROM h""",
    "motif_wide": f"WITH m AS ({I.MOTIFS_SQL}) SELECT motif, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"max(CASE WHEN base = '{b}' THEN count END) AS \"{b}\"" for b in "ACGT") + " FROM m GROUP BY motif, pos",
    "relative_entropy": f"""{_W}, x AS (SELECT motif, max(pos) + 1 AS width FROM w GROUP BY motif){_BOTH},
        h AS (SELECT l.motif AS long_, l.width AS lw, t.motif AS short_, unnest(range(1 - t.width, l.width)) AS shift FROM x l JOIN x t ON l.width >= t.width AND l.motif <> t.motif),
        j AS (SELECT long_, short_, shift, s.strand, s.freq AS p, coalesce(q.freq, 0.25) AS q FROM h JOIN s ON s.motif = short_ LEFT JOIN w q ON q.motif = long_ AND q.pos = s.pos + shift AND q.base = s.base),
        d AS (SELECT long_, short_, shift, strand, sum(p * log2(p / q)) AS d1, sum(q * log2(q / p)) AS d2 FROM j GROUP BY ALL),
        e AS (SELECT long_, short_, min(least(d1, d2)) AS distance FROM d GROUP BY ALL),
        b AS (SELECT long_ AS a, short_ AS b, distance FROM e UNION ALL SELECT short_, long_, distance FROM e UNION ALL SELECT motif, motif, 0.0 FROM x)
        SELECT a, b, round(min(distance), 6) + 0.0 AS distance FROM b GROUP BY a, b""",
    "expected_score": f"""{_W}, x AS (SELECT motif, max(pos) + 1 AS width FROM w GROUP BY motif){_BOTH},
        h AS (SELECT a.motif AS a, b.motif AS b, unnest(range(0, b.width)) AS shift FROM x a CROSS JOIN x b),
        k AS (SELECT *, unnest(['+', '-']) AS strand FROM h),
        j AS (SELECT k.a, k.b, k.shift, k.strand, w.weight, coalesce(s.freq, 0.25) AS p FROM k JOIN w ON w.motif = k.a LEFT JOIN s ON s.motif = k.b AND s.strand = k.strand AND s.pos = w.pos + k.shift AND s.base = w.base),
        e AS (SELECT a, b, shift, strand, sum(p * weight) AS score FROM j GROUP BY ALL)
        SELECT a, b, round(max(score), 6) + 0.0 AS score FROM e GROUP BY a, b""",
    "base_frequencies": f"WITH m AS ({I.MASKED_SQL}), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base), c AS (SELECT base, CAST(sum(length(seq) - length(replace(seq, base, ''))) AS BIGINT) AS n FROM m CROSS JOIN b GROUP BY base) SELECT base, n, round(n / sum(n) OVER (), 6) + 0.0 AS freq FROM c",
    "clean_runs": f"""WITH m AS ({I.MASKED_SQL}), t AS (SELECT seq_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS c FROM m WHERE seq <> ''),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS island FROM t WHERE c <> 'N')
        SELECT seq_id, CAST(min(i) AS INTEGER) AS begin, string_agg(c, '' ORDER BY i) AS run FROM g GROUP BY seq_id, island HAVING count(*) >= 3""",
    "gram_counts": f"{_GRAMS} SELECT gram, n FROM n",
    "context_counts": f"{_GRAMS} SELECT substring(gram, 1, 2) AS context, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1",
    "gram_probability": f"{_GRAMS} SELECT gram, round(n / sum(n) OVER (PARTITION BY substring(gram, 1, 2)), 6) + 0.0 AS p FROM n",
    "all_gram_counts": f"""WITH s AS ({I.SEQUENCES_SQL}), t AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM s), k AS (SELECT *, unnest([1, 2, 3]) AS k FROM t)
        SELECT substring(seq, i, k) AS gram, count(*) AS n FROM k WHERE i + k <= length(seq) + 1 GROUP BY 1""",
}
