"""A PySpark-native engine for ledger-traffic correlation, graphs, scoring and evidence."""
