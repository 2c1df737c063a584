"""Schemas of the tables that the operators read and give."""

READS = "read_ord long, read_name string, contig string, ref_start int, mapq int, flag int, cigar string, seq string"
REFERENCE = "contig string, block int, seq string"
VARIANTS = "rec_ord long, contig string, pos int, ref string, alts array<string>, gt array<int>, filter string, qual double"
BED = "contig string, start int, stop int"
LABELLED = "contig string, start int, stop int, ref string, allele string, gt int"
