"""Structured Streaming forms (extensions): incremental risk, shadow routing, bounded failure memory, windows."""
