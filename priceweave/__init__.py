"""Spark-first engine that compares a reorder list with many supplier price lists."""
