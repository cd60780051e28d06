"""Citation coverage and traceability as Spark DataFrame programs."""
