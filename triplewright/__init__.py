"""Graph queries, rules and inference as Spark DataFrame plans."""
