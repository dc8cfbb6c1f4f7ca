"""Batch operators; the streaming jobs reuse them."""
