"""strataq: a Spark-first engine for retrieval, content rules and corpus analytics."""
