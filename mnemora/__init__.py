"""A PySpark-native engine for hybrid text retrieval and knowledge-base analytics."""
