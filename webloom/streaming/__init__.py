"""Structured Streaming twins of the batch operators (ST1-ST7)."""
