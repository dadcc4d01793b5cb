"""Writers: GFF, text, matrices, the warehouse."""
