"""inkfathom: a Spark-first engine for document retrieval analytics."""
