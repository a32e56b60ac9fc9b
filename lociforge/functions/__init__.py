"""Column-level building blocks: bases, CIGAR, MD, qualities and genotypes."""
