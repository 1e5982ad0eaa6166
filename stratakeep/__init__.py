"""A PySpark-native table engine: keyed tables, a strict SQL dialect, transactions, a byte-key store."""
