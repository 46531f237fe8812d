"""millrace: record linkage, feature extraction, retrieval and ranking as Spark DataFrame operators."""
