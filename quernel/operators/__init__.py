"""Table changes and DataFrame helpers."""
