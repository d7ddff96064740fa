"""Schema resolution and query planning."""
