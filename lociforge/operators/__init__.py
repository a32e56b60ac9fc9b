"""DataFrame-to-DataFrame operators over reads, base rows, intervals and genotypes."""
