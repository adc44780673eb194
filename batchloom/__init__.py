"""Spark-native audit of batch production records, with corpus operators in the optional subpackage ``llm``."""
