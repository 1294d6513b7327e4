"""Structured Streaming: the batch plans run on micro-batches."""
