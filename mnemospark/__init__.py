"""A PySpark-native memory engine: layered memory tables, hybrid retrieval, graph queries and consolidation."""
