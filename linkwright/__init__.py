"""PySpark-native record linkage and corpus analytics."""
