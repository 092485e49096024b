"""Operators over DataFrames: retrieval, graph, search DSL, vector aggregates."""
