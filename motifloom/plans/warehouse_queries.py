"""The star schema of a staging table derived from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import warehouse as W
from ..storage import stored
from . import inputs as I


def staging(spark, sf_dir):
    """An order is a module; its lines are sites, a return flag a species, a line status a chromosome, a supplier a gene."""
    lines = I.table(spark, sf_dir, "lineitem").join(I.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    species = F.when(F.col("l_returnflag") == "A", "HUMAN").when(F.col("l_returnflag") == "N", "MOUSE").otherwise("RAT")
    gene = F.concat(F.when(F.col("l_returnflag") == "A", "ENSG").otherwise("ENSMUS"), F.col("l_linestatus"))
    begin = F.col("l_linenumber") * 50 + (F.col("l_partkey") % 20).cast("int")
    site = lines.select(
        F.col("o_orderpriority").alias("file"), species.alias("species"), gene.alias("gene"), F.lower(gene).alias("gene_name"), F.when(F.col("l_linestatus") == "F", "Crick").otherwise("Watson").alias("strand"),
        F.lit("db").alias("db"), F.col("l_linestatus").alias("chromosome"), F.lit(1000).alias("slice_start"), F.lit(9000).alias("slice_end"), F.concat(F.lit("tf"), F.col("l_suppkey") % 7).alias("kind"),
        begin.cast("int").alias("begin"), (begin + 6 + F.col("l_suppkey") % 7).cast("int").alias("end"), F.col("l_quantity").alias("score"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("site_strand"),
        F.col("l_orderkey").cast("int").alias("module"), F.col("l_discount").alias("weight"),
    )
    by = ["file", "species", "gene", "gene_name", "strand", "db", "chromosome", "slice_start", "slice_end", "module"]
    head = site.groupBy(*by).agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    total = site.groupBy("file", "module").agg(F.sum("score").alias("score"))
    head = head.join(total, ["file", "module"]).withColumns({"kind": F.lit("CisModule"), "site_strand": F.lit("."), "weight": F.lit(None).cast("double")})
    return site.unionByName(head.select(*site.columns))


def _query(name: str):
    def run(spark, sf_dir):
        return W.star(stored(staging(spark, sf_dir), "staging"), name)[name]

    run.__name__ = f"star_{name}"
    return run


def species_of_gene(spark, sf_dir):
    return staging(spark, sf_dir).select("gene").distinct().withColumn("species", W.species_of(F.col("gene")))


QUERIES = {"star_staging": staging, "species_of_gene": species_of_gene} | {f"star_{n}": _query(n) for n in ("sequence", "slice", "module", "module_slice", "region", "factor", "column", "site")}

_G = "CASE WHEN l_returnflag = 'A' THEN 'ENSG' ELSE 'ENSMUS' END || l_linestatus"
_B = "l_linenumber * 50 + l_partkey % 20"
_STAGING = f"""WITH t AS (SELECT o_orderpriority AS file, CASE l_returnflag WHEN 'A' THEN 'HUMAN' WHEN 'N' THEN 'MOUSE' ELSE 'RAT' END AS species, {_G} AS gene, lower({_G}) AS gene_name,
    CASE WHEN l_linestatus = 'F' THEN 'Crick' ELSE 'Watson' END AS strand, 'db' AS db, l_linestatus AS chromosome, 1000 AS slice_start, 9000 AS slice_end, 'tf' || (l_suppkey % 7) AS kind,
    CAST({_B} AS INTEGER) AS begin_, CAST({_B} + 6 + l_suppkey % 7 AS INTEGER) AS end_, l_quantity AS score, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS site_strand, CAST(l_orderkey AS INTEGER) AS module, l_discount AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  hd AS (SELECT file, species, gene, gene_name, strand, db, chromosome, slice_start, slice_end, module, min(begin_) AS begin_, max(end_) AS end_ FROM t GROUP BY ALL),
  tt AS (SELECT file, module, sum(score) AS score FROM t GROUP BY ALL),
  st AS (SELECT * FROM t UNION ALL BY NAME SELECT hd.*, 'CisModule' AS kind, tt.score, '.' AS site_strand, CAST(NULL AS DOUBLE) AS weight FROM hd JOIN tt USING (file, module)),
  seqs AS (SELECT CAST(row_number() OVER (ORDER BY species, chromosome, db) AS INTEGER) AS id, species, chromosome AS name, db FROM (SELECT DISTINCT species, chromosome, db FROM st)),
  facts AS (SELECT CAST(row_number() OVER (ORDER BY kind) AS INTEGER) AS id, kind AS name, min(end_ - begin_) AS width FROM st WHERE kind <> 'CisModule' GROUP BY kind),
  mods AS (SELECT CAST(row_number() OVER (ORDER BY file, module) AS INTEGER) AS id, file, module, max(score) AS score FROM st WHERE kind = 'CisModule' GROUP BY file, module),
  sl0 AS (SELECT DISTINCT q.id AS seq_id, slice_start AS begin_, slice_end AS end_, gene, gene_name, CASE WHEN strand = 'Crick' THEN 1 ELSE 0 END AS reverse, file FROM st JOIN seqs q ON q.species = st.species AND q.name = st.chromosome AND q.db = st.db),
  slices AS (SELECT CAST(row_number() OVER (ORDER BY file, gene, seq_id, begin_, end_, reverse, gene_name) AS INTEGER) AS id, * FROM sl0),
  rg0 AS (SELECT DISTINCT q.id AS seq_id, slice_start + begin_ AS begin_, slice_start + end_ AS end_, m.id AS module_id FROM st JOIN mods m USING (file, module) JOIN seqs q ON q.species = st.species AND q.name = st.chromosome AND q.db = st.db WHERE kind = 'CisModule'),
  regs AS (SELECT CAST(row_number() OVER (ORDER BY module_id, seq_id, begin_, end_) AS INTEGER) AS id, * FROM rg0),
  cl0 AS (SELECT m.id AS module_id, CAST(row_number() OVER (PARTITION BY m.id ORDER BY begin_, end_, kind, site_strand, st.score) AS INTEGER) AS nth, f.id AS factor_id, st.score AS delta FROM st JOIN mods m USING (file, module) JOIN facts f ON f.name = kind WHERE kind <> 'CisModule' AND species = 'HUMAN'),
  cols AS (SELECT CAST(row_number() OVER (ORDER BY module_id, nth) AS INTEGER) AS id, * FROM cl0),
  si0 AS (SELECT r.id AS region_id, m.id AS module_id, CAST(row_number() OVER (PARTITION BY r.id ORDER BY st.begin_, st.end_, kind, site_strand, st.score, weight, strand) AS INTEGER) AS nth, weight,
    CASE WHEN strand = 'Crick' THEN slice_end - st.end_ ELSE slice_start + st.begin_ END AS pos, CASE WHEN strand = 'Crick' THEN CASE WHEN site_strand = '-' THEN '+' ELSE '-' END ELSE site_strand END AS strand
    FROM st JOIN mods m USING (file, module) JOIN seqs q ON q.species = st.species AND q.name = st.chromosome AND q.db = st.db JOIN regs r ON r.module_id = m.id AND r.seq_id = q.id WHERE kind <> 'CisModule')"""

ORACLE_SQL = {
    "star_staging": f'{_STAGING} SELECT * RENAME (begin_ AS begin, end_ AS "end") FROM st',
    "species_of_gene": f"{_STAGING} SELECT DISTINCT gene, CASE WHEN gene LIKE 'ENSG%' THEN 'HUMAN' WHEN gene LIKE 'ENSMUS%' THEN 'MOUSE' END AS species FROM st",
    "star_sequence": f"{_STAGING} SELECT * FROM seqs",
    "star_slice": f'{_STAGING} SELECT * RENAME (begin_ AS begin, end_ AS "end") FROM slices',
    "star_module": f"{_STAGING} SELECT * FROM mods",
    "star_module_slice": f"{_STAGING} SELECT DISTINCT m.id AS module_id, s.id AS slice_id FROM st JOIN mods m USING (file, module) JOIN slices s ON s.file = st.file AND s.gene = st.gene WHERE kind = 'CisModule'",
    "star_region": f'{_STAGING} SELECT * RENAME (begin_ AS begin, end_ AS "end") FROM regs',
    "star_factor": f"{_STAGING} SELECT id, name, width FROM facts",
    "star_column": f"{_STAGING} SELECT * FROM cols",
    "star_site": f"{_STAGING} SELECT CAST(row_number() OVER (ORDER BY region_id, s.nth) AS INTEGER) AS id, region_id, s.nth, c.id AS column_id, pos, s.strand, weight FROM si0 s JOIN cols c USING (module_id, nth)",
}
