"""Declarative entity queries and set-based mutations on Spark."""
