"""Logs at rest."""
