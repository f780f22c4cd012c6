"""Derivative and export plans."""
