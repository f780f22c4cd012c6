"""Operators on the catalog, marks, detector results and frames."""
