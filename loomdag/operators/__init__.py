"""Causal, row, voiding, delta and set operators over columnar logs."""
