"""Relational, graph and retrieval operators; every function takes and returns DataFrames."""
