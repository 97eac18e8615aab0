"""Readers (Parquet tables, JDBC, file listings) and writers (table sinks)."""
