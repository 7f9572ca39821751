"""Batch document retrieval, evaluation and corpus upkeep as PySpark DataFrame plans."""
