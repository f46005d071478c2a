"""tessera: matching, retrieval and corpus preparation as plain Spark DataFrame jobs."""
