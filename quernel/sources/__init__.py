"""Parquet tables, the catalog, and state in the shared folder."""
