"""Operators over DataFrames: filters, spatial joins, graphs, evidence, reconciliation, rules."""
