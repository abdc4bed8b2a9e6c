"""Date patterns and bucket numbers."""
