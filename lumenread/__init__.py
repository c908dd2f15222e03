"""Reading-difficulty analytics expressed as Spark plans."""
