"""Lineage, runs and the registered queries."""
