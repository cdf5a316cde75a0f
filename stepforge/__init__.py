"""Step-by-step reasoning analytics expressed as Spark DataFrame plans."""
