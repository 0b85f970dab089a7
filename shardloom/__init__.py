"""Spark-first engine for hash-partitioned, multi-tenant tables."""
