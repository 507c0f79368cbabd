"""Document-corpus analytics and retrieval evaluation on Spark."""
