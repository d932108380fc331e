"""Fixed word lists."""
