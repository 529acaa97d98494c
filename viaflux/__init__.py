"""Spark-first engine for road-network traffic volumes."""
