"""Canonical forms and the predicate compiler."""
