"""Retrieval analytics and answering over versioned text collections, as Spark plans."""
