"""Privacy-preserving retrieval, grounding, integrity and privacy operators as Spark DataFrame functions."""
