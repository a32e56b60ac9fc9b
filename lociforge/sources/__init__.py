"""Readers and writers: SAM text, FASTA, VCF, Parquet tables and locus specs."""
