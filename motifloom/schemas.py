"""Schemas of the library's tables, as DDL."""

SEQUENCES = "seq_id string, description string, seq string"
#: pos counts from 0.
MOTIFS = "motif string, pos int, base string, count double"
SNP = "struct<ambig: string, allele: string, offset: int, score_diff: double>"
SITES = f"seq string, motif string, begin int, end int, score double, strand string, alt_score double, snps array<{SNP}>"
#: One row a sequence and column of a module. cum_score: up to this column; delta: what it adds.
COLUMNS = "module int, col int, seq string, motif string, strand string, begin int, end int, weight double, cum_score double, delta double, module_score double"
GFF_FIELDS = ("seq", "source", "motif", "begin", "end", "score", "strand", "frame", "annotation")
