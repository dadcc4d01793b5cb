"""Filters, coordinates, order and joins of sites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.penalty import Weights
from ..functions.text import browser_link, memory_text, parse_slice_name, slice_length, time_text
from ..operators import sites as S
from ..operators import stats
from . import inputs as I


def next_cells(spark, sf_dir):
    """Cells of every sequence with the one of the next number."""
    own = I.sites(spark, sf_dir)
    x = own.withColumn("pair", F.col("seq").cast("long"))
    y = own.withColumn("pair", F.col("seq").cast("long") - 1)
    side = lambda t, s: t.select("pair", "motif", "strand", *(F.col(c).alias(f"{n}_{s}") for c, n in (("seq", "seq"), ("begin", "begin"), ("end", "end"), ("score", "weight"))))
    return side(x, "x").join(side(y, "y"), ["pair", "motif", "strand"]).drop("pair")


def site_cells(spark, sf_dir):
    return next_cells(spark, sf_dir)


def site_steps(spark, sf_dir):
    cells = next_cells(spark, sf_dir).withColumn("id", F.concat_ws(":", "begin_x", "begin_y", "motif", "strand"))
    return S.steps(cells).withColumn("penalty", F.round("penalty", 6)).select("seq_x", "seq_y", "from_id", "to_id", "penalty")


def site_head(spark, sf_dir):
    return S.head(I.sites(spark, sf_dir), 5)


def site_top(spark, sf_dir):
    return S.top(I.sites(spark, sf_dir), ["seq"], "score", 3, "begin", "motif", "strand").select("seq", "rank", "motif", "begin", "score")


def site_part(spark, sf_dir):
    """Its SQL leaves open which of two sites alike in place, motif and strand comes first; here the earlier event does."""
    return S.part(I.sites(spark, sf_dir, "event_id"), 2, 6, "event_id").drop("event_id")


def site_part_of(spark, sf_dir):
    return S.only(I.sites(spark, sf_dir), "3", "8")


def site_counts(spark, sf_dir):
    return S.match_counts(I.sites(spark, sf_dir))


def site_removed(spark, sf_dir):
    return S.without_sequences(I.sites(spark, sf_dir), "1[0-9]?$")


def motif_removed(spark, sf_dir):
    return S.without_motif(I.motifs(spark), 1)


def site_unstranded(spark, sf_dir):
    return S.without_strand(I.sites(spark, sf_dir))


def site_shifted(spark, sf_dir):
    customers = I.table(spark, sf_dir, "customer")
    names = customers.select(F.col("c_custkey").cast("string").alias("seq"), F.concat(F.lit("n"), "c_nationkey").alias("new_seq"), (F.col("c_nationkey") * 1000).alias("offset"))
    return S.shifted(I.sites(spark, sf_dir), names)


def site_forward(spark, sf_dir):
    crick = F.col("seq").cast("long") % 3 == 0
    return S.on_forward_strand(I.sites(spark, sf_dir), crick, F.lit(100), F.lit(-60000))


def site_randomised(spark, sf_dir):
    return S.randomised(I.sites(spark, sf_dir), 7)


def site_union(spark, sf_dir):
    own = I.sites(spark, sf_dir)
    return own.unionByName(S.without_strand(own)).distinct()


def insert_ignore(spark, sf_dir):
    nations = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    suppliers = I.table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") * 2).cast("int").alias("key")).agg(F.min("s_name").alias("name"))
    return S.inserted(nations, suppliers, ["key"])


def _columns(spark, sf_dir):
    own = I.sites(spark, sf_dir).withColumn("module", F.col("seq").cast("int"))
    order = Window.partitionBy("module").orderBy("begin", "end", "motif", "strand", "score")
    return own.withColumns({"col": F.row_number().over(order), "cum_score": F.round(F.sum(F.col("score").cast("decimal(18,4)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), 4)})


def column_delta(spark, sf_dir):
    return S.with_delta(_columns(spark, sf_dir)).select("module", "col", F.round("delta", 4).alias("delta"))


def module_extents(spark, sf_dir):
    return S.extents(_columns(spark, sf_dir))


def modules_down_to(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("module"), F.col("o_totalprice").alias("score"))
    return S.down_to(orders, ["o_orderpriority"], 400000.0)


def supported_columns(spark, sf_dir):
    counts = I.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("pairs"))
    return S.well_supported(counts, 30)


def expectation_model(spark, sf_dir):
    modules = I.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("module"), F.col("o_totalprice").alias("score"))
    fit = stats.expectation_model(modules, ["o_orderpriority"])
    return fit.select("o_orderpriority", *(F.round(c, 6).alias(c) for c in ("alpha", "rmse", "r_squared")), F.round(F.col("beta") * 1e6, 6).alias("beta_millionth"))


def expected_modules(spark, sf_dir):
    modules = I.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("module"), F.col("o_totalprice").alias("score"))
    fit = stats.expectation_model(modules, ["o_orderpriority"])
    value = stats.expected_modules(F.col("score"), F.col("alpha"), F.col("beta"), F.col("r_squared"))
    return modules.join(fit, "o_orderpriority").select("module", F.round(value, 4).alias("expected"))


def term_variance(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem")
    terms = lines.select(F.col("l_suppkey").alias("module"), F.col("l_quantity").alias("bonus"), F.col("l_tax").alias("distance"), F.col("l_discount").alias("bend"), F.lit(0.0).alias("twist"))
    out = stats.term_summary(terms)
    return out.select("module", *(F.round(c, 6).alias(c) for c in out.columns if c != "module"))


def name_distance(spark, sf_dir):
    """Edit distance between the names of parts with successive keys."""
    parts = I.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return parts.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "next_name").alias("distance"))


def slice_names(spark, sf_dir):
    name = F.concat_ws("|", F.concat(F.lit("SP"), F.col("c_nationkey").cast("string")), F.concat(F.col("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") + 99).cast("string")), F.concat(F.lit("ENSG"), F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 2 == 0, "Crick"))
    named = I.table(spark, sf_dir, "customer").select(name.alias("name"))
    parts = parse_slice_name(F.col("name"))
    return named.select("name", *(c.alias(k) for k, c in parts.items()), slice_length(F.col("name")).alias("length"), browser_link(F.col("name")).alias("link"))


def text_formats(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 977).alias("n"))
    return orders.select("o_orderkey", memory_text(F.col("n")).alias("memory"), time_text(F.col("n")).alias("time"))


QUERIES = {f.__name__: f for f in (site_cells, site_steps, site_head, site_top, site_part, site_part_of, site_counts, site_removed, motif_removed, site_unstranded, site_shifted, site_forward, site_randomised, site_union, insert_ignore, column_delta, module_extents, modules_down_to, supported_columns, expectation_model, expected_modules, term_variance, name_distance, slice_names, text_formats)}

_S = f"WITH s AS ({I.SITES_SQL})"
_ALL = 'seq, motif, begin_ AS begin, end_ AS "end", score, strand'
_CELLS = f"""{_S}, c AS (SELECT x.seq AS seq_x, y.seq AS seq_y, x.motif, x.strand, x.begin_ AS begin_x, x.end_ AS end_x, x.score AS weight_x, y.begin_ AS begin_y, y.end_ AS end_y, y.score AS weight_y
    FROM s x JOIN s y ON CAST(y.seq AS BIGINT) = CAST(x.seq AS BIGINT) + 1 AND x.motif = y.motif AND x.strand = y.strand)"""
_COLUMNS = f"""{_S}, k AS (SELECT *, CAST(seq AS INTEGER) AS module, row_number() OVER o AS col, round(CAST(sum(CAST(score AS DECIMAL(18, 4))) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 4) AS cum_score
    FROM s WINDOW o AS (PARTITION BY seq ORDER BY begin_, end_, motif, strand, score))"""
_w = Weights()
_MODEL = """WITH r AS (SELECT o_orderpriority, o_orderkey AS module, o_totalprice AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
    f AS (SELECT o_orderpriority, regr_intercept(ln(r), score) AS alpha, regr_slope(ln(r), score) AS beta, sqrt((regr_syy(ln(r), score) - regr_sxy(ln(r), score) ^ 2 / regr_sxx(ln(r), score)) / count(*)) AS rmse, regr_r2(ln(r), score) AS r_squared
      FROM r WHERE n > 30 AND r > 10 AND r <= 50 GROUP BY o_orderpriority)"""

ORACLE_SQL = {
    "site_cells": f"{_CELLS} SELECT * FROM c",
    "site_steps": f"""{_CELLS}, d AS (SELECT *, concat_ws(':', begin_x, begin_y, motif, strand) AS id FROM c),
        p AS (SELECT *, unnest(generate_series((end_x + 1) // 1000, (end_x + 999) // 1000)) AS part FROM d), q AS (SELECT *, begin_x // 1000 AS part FROM d),
        e AS (SELECT a.seq_x, a.seq_y, a.id AS from_id, b.id AS to_id, CAST(b.begin_x - a.end_x - 1 AS DOUBLE) AS u, CAST(b.begin_y - a.end_y - 1 AS DOUBLE) AS v FROM p a JOIN q b ON a.seq_x = b.seq_x AND a.seq_y = b.seq_y AND a.part = b.part
          AND b.begin_x - a.end_x BETWEEN 1 AND 999 AND b.begin_y - a.end_y BETWEEN 1 AND 999),
        t AS (SELECT *, abs(u - v) * (2 * pi() / {_w.rotation}) AS turn FROM e), g AS (SELECT *, turn - 2 * pi() * floor(turn / (2 * pi())) AS m FROM t), h AS (SELECT *, least(m, 2 * pi() - m) AS angle FROM g)
        SELECT seq_x, seq_y, from_id, to_id, round(CASE WHEN u + v > 0 THEN {_w.mu} * (u + v) / 2 + {_w.nu} * (u - v) * (u - v) / (u + v) + {_w.xi} * angle * angle / (u + v) ELSE 0 END, 6) AS penalty FROM h""",
    "site_head": f"{_S}, r AS (SELECT *, rank() OVER (PARTITION BY seq ORDER BY begin_) AS r FROM s) SELECT {_ALL} FROM r WHERE r <= 5",
    "site_top": f"{_S}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY score DESC, begin_, motif, strand) AS INTEGER) AS rank FROM s) SELECT seq, rank, motif, begin_ AS begin, score FROM r WHERE rank <= 3",
    "site_part": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY begin_, end_, motif, strand) - 1 AS i FROM s) SELECT {_ALL} FROM r WHERE i BETWEEN 2 AND 6",
    "site_part_of": f"{_S} SELECT {_ALL} FROM s WHERE seq IN ('3', '8')",
    "site_counts": f"{_S} SELECT seq, count(*) AS n FROM s GROUP BY ROLLUP (seq)",
    "site_removed": f"{_S} SELECT {_ALL} FROM s WHERE NOT regexp_matches(seq, '^(?:1[0-9]?$)')",
    "motif_removed": f"SELECT motif, CAST(pos AS INTEGER) AS pos, base, count FROM ({I.MOTIFS_SQL}) WHERE motif <> 'M2'",
    "site_unstranded": f"{_S} SELECT seq, motif, begin_ AS begin, end_ AS \"end\", score, '.' AS strand FROM s",
    "site_shifted": f"""{_S} SELECT coalesce('n' || c_nationkey, seq) AS seq, motif, CAST(begin_ + coalesce(c_nationkey * 1000, 0) AS INTEGER) AS begin, CAST(end_ + coalesce(c_nationkey * 1000, 0) AS INTEGER) AS "end", score, strand
        FROM s LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = seq""",
    "site_forward": f"""{_S} SELECT seq, motif, score, CAST(CASE WHEN CAST(seq AS BIGINT) % 3 = 0 THEN 60000 - end_ + 1 ELSE 100 + begin_ - 1 END AS INTEGER) AS begin,
        CAST(CASE WHEN CAST(seq AS BIGINT) % 3 = 0 THEN 60000 - begin_ + 1 ELSE 100 + end_ - 1 END AS INTEGER) AS "end", CASE WHEN CAST(seq AS BIGINT) % 3 = 0 THEN translate(strand, '+-', '-+') ELSE strand END AS strand FROM s""",
    "site_union": f"{_S} SELECT {_ALL} FROM s UNION SELECT seq, motif, begin_, end_, score, '.' FROM s",
    "insert_ignore": """WITH n AS (SELECT CAST(s_nationkey * 2 AS INTEGER) AS key, min(s_name) AS name FROM supplier GROUP BY 1)
        SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT key, name FROM n WHERE key NOT IN (SELECT n_nationkey FROM nation)""",
    "column_delta": f"{_COLUMNS} SELECT module, CAST(col AS INTEGER) AS col, round(cum_score - lag(cum_score, 1, 0.0) OVER (PARTITION BY module ORDER BY col), 4) AS delta FROM k",
    "module_extents": f'{_COLUMNS} SELECT module, seq, min(begin_) AS begin, max(end_) AS "end", max(cum_score) AS score FROM k GROUP BY module, seq',
    "modules_down_to": "WITH l AS (SELECT o_orderpriority, o_orderkey AS module, o_totalprice AS score, lag(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders) SELECT o_orderpriority, module, score FROM l WHERE b IS NULL OR b > 400000",
    "supported_columns": "SELECT l_partkey, count(*) AS pairs FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30",
    "expectation_model": f"{_MODEL} SELECT o_orderpriority, round(alpha, 6) AS alpha, round(rmse, 6) AS rmse, round(r_squared, 6) AS r_squared, round(beta * 1e6, 6) AS beta_millionth FROM f",
    "expected_modules": f"{_MODEL} SELECT r.module, round(CASE WHEN f.r_squared > 0.1 THEN exp(f.alpha + f.beta * r.score) END, 4) AS expected FROM r JOIN f USING (o_orderpriority)",
    "term_variance": "SELECT l_suppkey AS module, " + ", ".join(f"round(avg({c}), 6) AS mean_{n}, round(var_pop({c}), 6) AS var_{n}" for c, n in (("l_quantity", "bonus"), ("l_tax", "distance"), ("l_discount", "bend"), ("0.0::DOUBLE", "twist"))) + " FROM lineitem GROUP BY l_suppkey",
    "name_distance": "SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "slice_names": """WITH n AS (SELECT *, concat_ws('|', 'SP' || c_nationkey, c_mktsegment || '.' || c_custkey || '-' || (c_custkey + 99), 'ENSG' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Crick' END) AS name FROM customer)
        SELECT name, 'SP' || c_nationkey AS species, c_mktsegment AS region, c_custkey AS start, c_custkey + 99 AS stop, 'ENSG' || c_custkey AS gene, c_custkey % 2 = 0 AS crick, CAST(100 AS BIGINT) AS length,
        'https://www.ensembl.org/SP' || c_nationkey || '/Location/View?r=' || c_mktsegment || ':' || c_custkey || '-' || (c_custkey + 99) AS link FROM n""",
    "text_formats": """WITH n AS (SELECT o_orderkey, o_orderkey * 977 AS n FROM orders)
        SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f kB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1)) ELSE printf('%.1f GB', round(n / 1073741824.0, 1)) END AS memory,
        concat_ws(' ', CASE WHEN n >= 86400 THEN (n // 86400) || 'd' END, CASE WHEN n >= 3600 THEN (n % 86400 // 3600) || 'h' END, CASE WHEN n >= 60 THEN (n % 3600 // 60) || 'm' END, (n % 60) || 's') AS time FROM n""",
}
