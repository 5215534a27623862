"""Format readers and MIME dispatch."""
