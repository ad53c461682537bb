"""Spark-native matching, ranking, evaluation and audit operators over text corpora."""
