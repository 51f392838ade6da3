"""Tessera: DataFrame-first analytics and corpus preparation on Apache Spark."""
