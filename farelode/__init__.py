"""farelode: a PySpark-native engine for policy documents, their clauses and their labels."""
