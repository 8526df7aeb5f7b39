"""Operators over DataFrames: retrieval, fusion, evaluation, corpus building, answering, log analytics."""
