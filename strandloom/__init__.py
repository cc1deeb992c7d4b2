"""Spark-first analytics over large collections of short sequences."""
