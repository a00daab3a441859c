"""Grounded retrieval analytics expressed as Spark DataFrame plans."""
