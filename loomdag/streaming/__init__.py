"""Causal-order ingest and streamed projection."""
