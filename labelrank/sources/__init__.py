"""Readers and writers for the reference's file formats (TSV, JSONL, TREC, Parquet vectors)."""
